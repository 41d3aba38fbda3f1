"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators of high recall propose spans that may overlap. Exact format checks confirm the
base kinds (email, ip, card, phone); every other candidate gets a score from boosted trees
over its format and its context, and is taken if the score reaches the threshold of its
generator. The trees learn on candidates of a bounded sample of documents, with the format
checks and context words as weak labels; the thresholds are set on all candidates of the
table, so that at least ``precision`` of what passes of each kind is labelled positive.

Null and empty texts have no spans. Rows of equal key and text are scanned once and judged
alike. All patterns run in linear time on any text: runs are possessive and begin at the
start of a run or where the last match ended. A table without both labels takes nothing
beyond the base.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with runs that don't give back where giving back can't help.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators beyond the base: what a reader may take for personal data.
LOOSE = {
    "spelt_email": r"(?i)\b[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,64}+(?: ?[\[(]? ?(?:dot|\.) ?[\])]? ?[a-z0-9-]{1,64}+){1,4}",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])(?=[0-9_-]{0,64}[A-Za-z])[A-Za-z0-9_-]{24,}+",
    "ipv6": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){5,7}[0-9a-f]{1,4}(?![0-9a-f:])",
}
#: A text without any of these has no candidates.
ANY = r"(?i)@|[0-9]|[\[(] ?at ?[\])]"
#: What must stand in a text before a pattern is tried on it.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{13}[0-9 -]*[0-9]", "phone": r"\+[0-9]", "spelt_email": r"(?i)[\[(] ?at ?[\])]", "national_id": "[0-9]-[0-9]{2}-[0-9]",
         "local_phone": r"[0-9][\x20.-][0-9]{4}", "iban": "[A-Z]{2}[0-9]{2}", "key": "[A-Za-z0-9_-]{24}", "ipv6": "(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]"}
CONTEXT = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|ssn|social|passport|card|visa|account|iban|bank|ip|addr|server|host|key|token|secret|password|passwd|api|write to)[^\n]{0,24}$"
FEATURES = ["generator", "n_chars", "n_digits", "n_letters", "n_marks", "n_runs", "digit_share", "luhn", "context", "glued_left", "glued_right", "n_distinct"]
AROUND = 48
#: A threshold that no score reaches.
NEVER = 2.0


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(s: Column) -> Column:
    """Luhn's check of the digits of a string."""
    d = F.transform(F.split(F.reverse(digits(s)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    added = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return added % 10 == 0


def confirmed(kind: Column, match: Column) -> Column:
    """The exact checks of the base kinds; false for every other generator."""
    n = F.length(digits(match))
    ip = F.forall(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", n.between(16, 19) & luhn_ok(match)).when(kind == "phone", n.between(8, 15)).otherwise(F.lit(False))


def parts(text: Column, pattern: str) -> Column:
    """Each match with the size of the gap before it and up to 48 characters of both gaps."""
    p = F.lit(pattern)
    gaps, matches = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("before"), matches.alias("match"), F.slice(gaps, 2, F.size(matches)).alias("after")), lambda x: F.struct(
        F.length(x["before"]).alias("gap"), x["match"].alias("match"), F.right(x["before"], F.lit(AROUND)).alias("left"), F.left(x["after"], F.lit(AROUND)).alias("right")))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _hash, kind, start, end, match, left, right of all generators' matches; offsets are code points.

    Texts don't travel: what stands beside a match is cut out before the exchange.
    """
    t = F.col("_text")
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(t.rlike(ANY))
    lists = [F.struct(F.lit(k).alias("kind"), F.when(t.rlike(GATES[k]), parts(t, p)).alias("list")) for k, p in (BASE | LOOSE).items()]
    found = slim.select("_key", F.xxhash64("_text").alias("_hash"), F.explode(F.array(*lists)).alias("_f")).filter(F.size("_f.list") > 0)
    flat = found.select("_key", "_hash", F.col("_f.kind").alias("kind"), F.posexplode("_f.list").alias("_pos", "_m")).select("_key", "_hash", "kind", "_pos", "_m.*")
    # The same document twice gives the same rows twice; one of each is enough.
    flat = flat.repartition("_key", "_hash").dropDuplicates(["_key", "_hash", "kind", "_pos"])
    upto = Window.partitionBy("_key", "_hash", "kind").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("match")).cast("long")).over(upto)
    return flat.withColumn("end", end).select("_key", "_hash", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "left", "right")


def described(found: DataFrame) -> DataFrame:
    """Candidates with the base check, whether a confirmed base span overlaps, and the features."""
    m = F.col("match")
    count = lambda c: (F.length(m) - F.length(F.regexp_replace(m, c, ""))).cast("double")
    d = found.withColumn("confirmed", confirmed(F.col("kind"), m))
    by = Window.partitionBy("_key", "_hash").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("confirmed"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("confirmed"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    d = d.withColumn("overlaps", F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    return d.withColumns({
        "generator": F.array_position(F.array(*[F.lit(k) for k in (BASE | LOOSE)]), F.col("kind")).cast("double"),
        "n_chars": F.length(m).cast("double"), "n_digits": count("[0-9]"), "n_letters": count("[A-Za-z]"), "n_marks": count("[^0-9A-Za-z]"),
        "n_runs": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"), "digit_share": count("[0-9]") / F.length(m),
        "luhn": luhn_ok(m).cast("double"), "context": F.col("left").rlike(CONTEXT).cast("double"),
        "glued_left": F.col("left").rlike(r"[0-9A-Za-z]$").cast("double"), "glued_right": F.col("right").rlike("^[0-9A-Za-z]").cast("double"),
        "n_distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
    })


def weak_label(d: DataFrame) -> DataFrame:
    """1 for confirmed base matches and for other candidates behind a context word, else 0."""
    own = F.col("kind").isin(*KINDS)
    return d.withColumn("label", F.when(own, F.col("confirmed")).otherwise((F.col("context") == 1) & (F.col("n_distinct") > 3)).cast("double"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, rounds: int = 10, depth: int = 3):
    """Trees from half of the ``sample`` documents of least key hash, or None.

    If that half has one label only, the ``sample`` candidates of either label with the least
    hash among all of the table take its place; None if the table has one label only.
    """
    picked = docs.select(key).filter(F.col(text).rlike(ANY)).orderBy(F.xxhash64(key), key).limit(sample)
    some = docs.join(F.broadcast(picked), key, "left_semi")
    half = F.pmod(F.xxhash64("_key", F.lit("half")), F.lit(2))
    rows = store.keep(labelled(some, key, text).filter(half == 0).select("label", *FEATURES), "pii-sample")
    if rows.select("label").distinct().count() < 2:
        every = labelled(docs, key, text)
        one = lambda x: every.filter(F.col("label") == x).orderBy(F.xxhash64("_key", "_hash", "kind", "start"), "_key", "kind", "start").limit(sample).select("label", *FEATURES)
        rows = store.keep(one(0.0).union(one(1.0)), "pii-sample")
        if rows.select("label").distinct().count() < 2:
            return None
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7).fit(packed)


def labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    return weak_label(described(candidates(docs, key, text))).filter(~F.col("overlaps"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", model=None) -> DataFrame:
    """_key, _hash, kind, start, end, confirmed, label, score of every candidate that counts.

    Confirmed ones have no score; those that overlap a confirmed one and, without a model, all others are left out.
    """
    d = weak_label(described(candidates(docs, key, text)))
    if model is None:
        return d.filter("confirmed").select("_key", "_hash", "kind", "start", "end", "confirmed", "label", F.lit(None).cast("double").alias("score"))
    d = d.filter(F.col("confirmed") | (~F.col("kind").isin(*KINDS) & ~F.col("overlaps")))
    d = scores(model, VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d))
    return d.select("_key", "_hash", "kind", "start", "end", "confirmed", "label", F.when(~F.col("confirmed"), F.col("score")).alias("score"))


def calibrate(found: DataFrame, precision: float = 0.95) -> dict[str, float]:
    """Threshold of each loose generator from all of its candidates in a judged table."""
    bins = found.filter("score is not null").groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.count(F.lit(1)), F.sum("label")).collect()  # 101 rows a kind at most
    return thresholds([tuple(b) for b in bins], precision)


def thresholds(bins: list[tuple], precision: float) -> dict[str, float]:
    """The least score of each loose kind from which on ``precision`` of the candidates are labelled positive.

    ``bins`` are (kind, hundredth of the score, count, positives). A kind whose every score falls
    short is never taken; one without a candidate is judged by the bins of all kinds together.
    """
    def least(own: list[tuple]) -> float:
        limit, n, good = NEVER, 0, 0
        for b in sorted({x[1] for x in own}, reverse=True):
            n, good = n + sum(x[2] for x in own if x[1] == b), good + sum(x[3] for x in own if x[1] == b)
            if good >= precision * n:
                limit = b / 100
        return limit

    by = {k: [x for x in bins if x[0] == k] for k in LOOSE}
    return {k: least(own or bins) for k, own in by.items()}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, precision: float = 0.95, rounds: int = 10, depth: int = 3):
    """(model from a bounded sample, threshold of each loose generator from all documents), or (None, {})."""
    model = train(docs, key, text, sample, rounds, depth)
    return (None, {}) if model is None else (model, calibrate(judged(docs, key, text, model), precision))


def scores(model, packed: DataFrame) -> DataFrame:
    return model.transform(packed).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", model=None, limits: dict[str, float] | None = None, out: str = "pii", found: DataFrame | None = None, meet: str | None = None) -> DataFrame:
    """All columns of docs and a struct: spans (kind, start, end; kinds as listed, then start), base (the base ones alone).

    ``found`` is the judged table of docs, if there is one already; ``meet`` a join strategy.
    """
    found = judged(docs, key, text, model if limits else None) if found is None else found
    enough = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in sorted((limits or {}).items())], F.lit(NEVER))
    base = found.filter(F.col("confirmed") | (F.col("score") >= enough)).select("_key", "_hash", "kind", "start", "end")
    no = F.array_position(F.array(*[F.lit(k) for k in (BASE | LOOSE)]), F.col("kind"))
    per = base.groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(F.struct(no.alias("no"), "start", "end", "kind"))).alias("_spans"))
    (h,) = store.fresh(docs, "_text_hash")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    per = per.hint(meet) if meet else per
    joined = keyed.join(per, keyed[key].eqNullSafe(per["_key"]) & (keyed[h] == per["_hash"]), "left")
    none = F.array().cast("array<struct<no:bigint,start:bigint,end:bigint,kind:string>>")
    all_spans = F.coalesce(per["_spans"], none)
    shown = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return joined.select(*store.own(keyed, docs), F.struct(
        shown(all_spans).alias("spans"), shown(F.filter(all_spans, lambda x: x["no"] <= len(KINDS))).alias("base")).alias(out))


def written(s: str) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", found: str = "pii") -> DataFrame:
    """Texts with every span replaced by its kind in angle brackets.

    Spans are merged in the order of their start; one that begins inside its predecessor
    only extends it. A null text stays null.
    """
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    by_start = F.array_sort(F.transform(F.col(f"{found}.spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(acc, x):
        gap = F.substr(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["done"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    new = F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    return docs.withColumn(text, F.when(F.size(f"{found}.spans") > 0, new).otherwise(F.col(text)))


def fit_and_detect(docs: DataFrame, out: str = "pii", meet: str | None = None) -> DataFrame:
    """As fit and detect, with the texts scanned once for both."""
    model = train(docs)
    found = store.keep(judged(docs, model=model), "pii-judged")
    return detect(docs, limits=calibrate(found), out=out, found=found, meet=meet)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the texts is replaced; n_chars follows; no document goes."""
    (out,) = store.fresh(docs, "_pii")
    new = redact(fit_and_detect(docs, out, "merge"), found=out)  # spans grow with the documents: never sent to all tasks
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*map(F.col, store.named(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = fit_and_detect(docs)
    kinds = F.transform("pii.base", lambda x: x["kind"])
    n = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *n, F.sha2(written("pii.base"), 256).alias("base_sha256"), written("pii.spans").alias("spans"))
