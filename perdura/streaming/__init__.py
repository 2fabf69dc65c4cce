"""Rolling estimates over event streams."""
