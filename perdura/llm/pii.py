"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

Base patterns find emails, IP addresses, cards and phones; these spans always stay.
Wider patterns propose further spans. Labelers of three sorts (formats, gazetteers,
context) vote on all spans for, against or not at all. Expectation-maximisation
estimates what each vote tells and how likely each span is personal; a logistic
classifier of span features, trained on those likelihoods, decides on the proposed
spans. All work on rows is DataFrame code; only counts by vote and feature pattern,
at most a few thousand rows whatever the input, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import stored

#: Kinds in the order in which they are listed; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "name", "id"]
#: Base patterns. Possessive and guarded forms find the same matches as the plain ones, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = [("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+")]
#: Wider patterns, with the kind that they propose.
WIDE = [
    ("email", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40} ?[\[(] ?at ?[\])] ?[a-z0-9-]{2,40}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]{2,20})+", "at"),
    ("phone", r"(?<![0-9+.(-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])", None),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}[0-9])(?=[0-9_+/-]{0,40}[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}", None),
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.? \p{Lu}\p{L}{1,20}(?: \p{Lu}\p{L}{1,20})?", None),
    ("name", r"(?=\p{Lu})(?<= )(?<=\b(?:[Nn]ame|[Nn]ombre|[Aa]uthor|[Cc]ontact|[Kk]ontakt|Dear|Sincerely|Regards)[:,]? )\p{Lu}\p{L}{1,20} \p{Lu}\p{L}{1,20}", None),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])", None),
]
#: Gazetteers and cues: fixed word lists.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|me|tv|co|de|at|ch|fr|be|lu|es|pt|it|nl|dk|se|no|fi|is|ie|uk|pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|za|eu)$"
FIRST_NAMES = r"(?i)\b(?:adam|ahmed|alan|albert|alex|alexander|alice|amy|ana|andrea|andreas|andrew|angela|anna|anne|anthony|antoine|antonio|barbara|beatriz|benjamin|bernard|brian|camille|carl|carla|carlos|carmen|caroline|catherine|charles|charlotte|chloe|christian|christina|christine|christopher|claire|claudia|cristina|daniel|david|deborah|denis|diego|dieter|dimitri|donald|dorothy|edward|elena|elizabeth|emily|emma|eric|erik|eva|fatima|felix|fernando|florian|francesca|francisco|francois|frank|gabriel|george|giovanni|grace|gregory|hannah|hans|heidi|heinrich|helen|helena|henry|ines|ingrid|isabel|isabelle|ivan|jack|jacques|james|jane|jason|javier|jean|jennifer|jens|jessica|joan|johanna|john|jonas|jorge|jose|joseph|juan|julia|julie|karen|karin|karl|katharina|kevin|klaus|laura|leo|leon|linda|lisa|louis|louise|lucas|lucia|luis|lukas|manuel|marc|marcel|margaret|maria|marie|mario|mark|markus|marta|martin|mary|matthew|max|mei|michael|michel|miguel|mohamed|monica|nancy|natalie|nicolas|nicole|oliver|olivia|pablo|patricia|paul|pedro|peter|petra|philip|pierre|rachel|rafael|ralf|raj|rebecca|richard|robert|roberto|rosa|ruth|sabine|samuel|sandra|sara|sarah|sebastian|silvia|simon|sofia|sophie|stefan|stephanie|steven|susan|sven|sylvie|teresa|thomas|tim|tom|ursula|victor|victoria|wei|william|wolfgang|yuki|yves)\b"
SECRET_HEADS = r"^(?:sk-|pk_|gh[a-z]_|AKIA|xox|eyJ)|^[0-9a-f]{32,64}$"
CUES = r"(?i)(?:e-?mail|courriel|correo|phone|telefon|téléphone|teléfono|tel|handy|call|fax|mobile|contact|kontakt|contacto|ip|server|host|adresse?|card|karte|carte|tarjeta|visa|konto|compte|cuenta|account|token|secret|geheim|passw|pwd|kennwort|api|key|schlüssel|clave|bearer|credential|name|nombre|nom|author|signed|sincerely|ssn|iban|passport)\W{0,8}\w*\W{0,3}$"
AGAINST = r"(?i)(?:version|section|article|page|isbn|doi|sha|commit|figure|chapter|https?:\S*|www\S*)\W{0,3}$"
CONTEXT = 32
SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"
LABELERS = ["v_format", "v_gazetteer", "v_context", "v_against", "v_edges"]
FEATURES = ["kind", "f_length", "f_digits", "f_left", "f_right", "f_cue", "f_head"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum divides by 10."""
    d = F.reverse(digits(m))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.when(i % 2 == 1, F.ascii(F.substr(d, i, F.lit(1))) - 48).otherwise((F.ascii(F.substr(d, i, F.lit(1))) - 48) * 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """What a base match must pass besides its pattern."""
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    n = F.length(digits(m))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(m)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def passing(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: valid(kind, x["m"]))


def located(df: DataFrame, out: str, text: str, kind: str, pattern: str, needs: str | None) -> DataFrame:
    """Adds the spans of a pattern's matches: places follow from the lengths of matches and of what is between."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", F.when(F.contains(F.col(text), F.lit(needs)), found).otherwise(none) if needs else found)
    df = df.withColumn("_gaps", F.when(F.size("_m") > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    both = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["pos"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.array_append(a["out"], F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    spans = F.when(F.size("_m") > 0, F.aggregate(both, empty, step)["out"]).otherwise(F.array().cast(SPAN))
    return df.withColumn(out, spans).drop("_m", "_gaps")


def described(span: Column, text: Column, base: bool) -> Column:
    """The span with its votes and features."""
    m, kind, s, e = span["m"], span["kind"], span["s"], span["e"]
    before = F.substr(text, F.greatest(s - CONTEXT, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT)))
    left, right = F.substr(text, s, F.when(s > 0, F.lit(1)).otherwise(F.lit(0))), F.substr(text, e + 1, F.lit(1))
    n_digits, n = F.length(digits(m)), F.length(m)
    cue, against = before.rlike(CUES), before.rlike(AGAINST)
    head = m.rlike(SECRET_HEADS)
    known = F.when(kind == "email", m.rlike(DOMAINS)).when(kind == "secret", head).when(kind == "name", m.rlike(FIRST_NAMES)).when(kind == "card", m.rlike("^[3-6]")).when(kind == "phone", m.rlike(r"^\+(?:1|3[0-9]|4[0-9]|[27-9])")).otherwise(F.lit(False))
    strict = F.lit(base) | (kind == "id") | ((kind == "secret") & (n >= 32) & (n_digits * 5 >= n)) | ((kind == "email") & m.rlike(r"(?i)[\[(] ?dot"))
    edge = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s\"'(<:,.;=]"), 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 2).otherwise(1)
    return F.struct(
        kind.alias("kind"), s.alias("s"), e.alias("e"), F.lit(base).alias("base"),
        F.when(strict, 1).otherwise(0).alias("v_format"),
        F.when(known, 1).otherwise(0).alias("v_gazetteer"),
        F.when(cue, 1).otherwise(0).alias("v_context"),
        F.when(against, -1).otherwise(0).alias("v_against"),
        F.when((edge(left) == 2) | (edge(right) == 2), -1).otherwise(0).alias("v_edges"),
        F.least(F.floor(n / 8), F.lit(6)).cast("int").alias("f_length"),
        F.floor(4 * n_digits / F.greatest(n, F.lit(1))).cast("int").alias("f_digits"),
        edge(left).alias("f_left"), edge(right).alias("f_right"), cue.cast("int").alias("f_cue"), head.cast("int").alias("f_head"),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans: base spans and proposed ones that touch no base span, each with votes and features. Narrow.

    A null text has no spans; repeated rows have the same. docs must have no columns that begin
    with an underscore; redact() takes any.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    names = []
    for kind, pattern, needs in BASE:
        names.append(f"_base_{kind}")
        df = located(df, names[-1], "_text", kind, pattern, needs)
        df = df.withColumn(names[-1], passing(names[-1], kind))
    df = df.withColumn("_base", F.concat(*names)).drop(*names)
    wide = []
    for i, (kind, pattern, needs) in enumerate(WIDE):
        wide.append(f"_wide_{i}")
        df = located(df, wide[-1], "_text", kind, pattern, needs)
    df = df.withColumn("_wide", F.concat(*wide)).drop(*wide)
    base = F.col("_base")
    apart = F.filter("_wide", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    df = df.withColumn("_wide", apart)
    text_ = F.col("_text")
    both = F.concat(F.transform("_base", lambda x: described(x, text_, True)), F.transform("_wide", lambda x: described(x, text_, False)))
    return df.withColumn("_spans", F.when((F.size("_base") > 0) | (F.size("_wide") > 0), both)).drop("_text", "_base", "_wide")


@dataclass
class Model:
    votes: dict[str, dict[tuple[int, int], float]]  # labeler -> (vote, class) -> probability
    weights: dict[str, dict[object, float]]  # feature -> value -> weight
    bias: float


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 40) -> tuple[dict, list[float]]:
    """Votes' probabilities by class, and each pattern's posterior, from (kind, votes, count).

    Every labeler starts as one that is right in eight of ten of its votes, worth ten
    spans; each kind as one whose spans are real in half of the cases.
    """
    n = len(LABELERS)
    start = {(1, 1): 0.4, (0, 1): 0.5, (-1, 1): 0.1, (1, 0): 0.1, (0, 0): 0.5, (-1, 0): 0.4}
    p = [dict(start) for _ in range(n)]
    prior = {k: 0.5 for k, _, _ in patterns}
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(patterns):
            a = math.log(prior[kind]) + sum(math.log(p[j][v, 1]) for j, v in enumerate(votes))
            b = math.log(1 - prior[kind]) + sum(math.log(p[j][v, 0]) for j, v in enumerate(votes))
            post[i] = 1 / (1 + math.exp(min(700, b - a)))
        for kind in prior:
            mass = [(q, c) for (k, _, c), q in zip(patterns, post, strict=True) if k == kind]
            prior[kind] = (5 + sum(q * c for q, c in mass)) / (10 + sum(c for _, c in mass))
        for j in range(n):
            for y in (0, 1):
                got = {v: 10 * start[v, y] for v in (-1, 0, 1)}
                for (_, votes, c), q in zip(patterns, post, strict=True):
                    got[votes[j]] += c * (q if y else 1 - q)
                total = sum(got.values())
                for v in got:
                    p[j][v, y] = got[v] / total
    return dict(zip(LABELERS, p, strict=True)), post


def logistic(rows: list[tuple[dict[str, object], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[dict, float]:
    """Weights of feature values from (features, likelihood, count), by gradient steps scaled by each value's mass."""
    w: dict[str, dict[object, float]] = {f: {x[f]: 0.0 for x, _, _ in rows} for f in FEATURES}
    mass = {f: {v: sum(c for x, _, c in rows if x[f] == v) for v in w[f]} for f in FEATURES}
    total, bias = sum(c for _, _, c in rows), 0.0
    for _ in range(rounds if rows else 0):
        slope: dict[str, dict[object, float]] = {f: dict.fromkeys(w[f], 0.0) for f in FEATURES}
        lean = 0.0
        for x, y, c in rows:
            z = bias + sum(w[f][x[f]] for f in FEATURES)
            d = c * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            lean += d
            for f in FEATURES:
                slope[f][x[f]] += d
        bias += rate * lean / total
        for f in FEATURES:
            for v in w[f]:
                w[f][v] += rate * (slope[f][v] / (mass[f][v] + 1) - ridge * w[f][v])
    return w, bias


def train(found: DataFrame) -> Model:
    """From candidates() of the whole table; what is collected are counts by pattern."""
    spans = found.filter("_spans is not null").select(F.explode("_spans").alias("x"))
    columns = list(dict.fromkeys([*LABELERS, *FEATURES]))
    rows = spans.select(*[F.col(f"x.{c}").alias(c) for c in columns]).groupBy(*columns).count().collect()
    rows = sorted(rows, key=str)
    by_votes: dict[tuple[str, tuple[int, ...]], float] = {}
    for r in rows:
        k = (r.kind, tuple(r[c] for c in LABELERS))
        by_votes[k] = by_votes.get(k, 0.0) + r["count"]
    patterns = [(k, v, c) for (k, v), c in sorted(by_votes.items())]
    votes, post = expectation_maximisation(patterns)
    likely = {(k, v): q for (k, v, _), q in zip(patterns, post, strict=True)}
    weights, bias = logistic([({f: r[f] for f in FEATURES}, likely[r.kind, tuple(r[c] for c in LABELERS)], r["count"]) for r in rows])
    return Model(votes, weights, bias)


def score(x: Column, model: Model) -> Column:
    """The classifier's log odds; a value never seen adds nothing."""
    total = F.lit(model.bias)
    for f, by in model.weights.items():
        if by:
            w = reduce(lambda a, kv: a.when(x[f] == kv[0], kv[1]), sorted(by.items(), key=str), F.when(F.lit(False), 0.0))
            total = total + w.otherwise(0.0)
    return total


def decided(found: DataFrame, model: Model) -> DataFrame:
    """Replaces _spans by spans: base spans and accepted ones, by kind as listed, then start. Narrow."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    kept = F.filter("_spans", lambda x: x["base"] | (score(x, model) > 0))
    plain = F.transform(kept, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))
    none = F.array().cast("array<struct<rank:int,s:int,e:int,kind:string,base:boolean>>")
    df = found.withColumn("spans", F.coalesce(F.array_sort(plain), none)).drop("_spans")
    added = F.col("spans")
    # Of proposed spans that overlap, the first in order stays.
    clear = F.filter(added, lambda x: x["base"] | ~F.exists(added, lambda o: ~o["base"] & (o["s"] < x["e"]) & (x["s"] < o["e"]) & ((o["rank"] < x["rank"]) | ((o["rank"] == x["rank"]) & (o["s"] < x["s"])))))
    return df.withColumn("spans", F.when(F.size(F.filter(added, lambda x: ~x["base"])) > 1, clear).otherwise(added))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """Writes <kind> over the spans of the text; overlapping spans become one, of the first one's kind. Drops spans."""
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))))
    none = F.array().cast("array<struct<s:int,e:int,kind:string>>")

    def merge(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        own = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when(F.size(a) == 0, F.array(own)).when(last["e"] > x["s"], F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), wider)).otherwise(F.array_append(a, own))

    df = df.withColumn("_cover", F.when(F.size("spans") > 0, F.aggregate(order, none, merge)))
    c, t = F.col("_cover"), F.col(text)
    pieces = F.transform(c, lambda x, i: F.concat(F.substr(t, F.coalesce(F.get(c, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(c, i - 1)["e"], F.lit(0))), F.lit("<"), x["kind"], F.lit(">")))
    tail = F.substr(t, F.element_at(c, -1)["e"] + 1, F.length(t))
    return df.withColumn(text, F.when(c.isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(t)).drop("_cover", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of a table with doc_id and spans."""
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.filter("spans", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in their text masked; a null text stays null.

    Trains on all of docs. Candidates are found once and stored with the documents. Other
    columns, whatever their names, and repeated rows stay. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c != text]
    row = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in others])
    found = stored(candidates(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))))
    clean = masked(decided(found, train(found)))
    return clean.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
