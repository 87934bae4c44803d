"""Personal data and secrets: base patterns, and boosted trees over further candidates.

Base spans (email, ip, card, phone) follow from their patterns and checks, and always stay. Besides,
generators of high recall propose overlapping candidates: values given to key-like names, long
tokens, loose numbers, written-out addresses and account numbers. Trees boosted by gradient
(GBTClassifier) judge every candidate by the format of the span and by what stands around it.

Labels come from other facts than the features: a candidate counts as private in training if it is
given to a password-like name, has an issuer's prefix, is written around an [at], or overlaps a base
span; the trees see neither names nor prefixes nor base spans. They learn from
all documents but those that a hash keeps for calibration. On these, each kind gets the
lowest threshold at which PRECISION of what passes is private, and not more than lets LEAST_RECALL
of what is private pass. Candidates that pass and overlap no base span become spans of their own
kinds (`secret`, `number`, `address`), so base kinds count base spans only; of two that overlap, in
order of their starts, the likelier stays, then the longer.

Edge cases: null and empty texts have no spans. Texts are scanned whole, however long, in linear
time; offsets are code points, ends exclusive. Repeated rows are judged each; ties go to the earlier
span. An empty table gives no rows. A table without both classes teaches nothing; the facts that
label candidates decide then. Columns with names used here pass through redact() unharmed.
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, passing, table

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "address")
#: The precision and recall that calibration asks for, and the share of documents that is kept for it.
PRECISION, LEAST_RECALL, CALIBRATION_SHARE = 0.98, 0.99, 0.3
TREES, DEPTH, SEED = 12, 3, 11

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only start where a run of digits starts, which keeps them linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Names that secrets are given to, and words near personal data.
SURE_NAMES = frozenset("password passwd pwd passphrase secret token apikey api_key access_key secret_key auth_token".split())
NAMED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]{1,40})[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?([^\s\"',;]{6,})")
NAME_PART = re.compile(r"pass|pwd|secret|token|key|auth|cred|private", re.I)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
NUMBER = re.compile(r"(?<![0-9])[(]?[0-9](?:[\x20().\-/]{0,3}[0-9])+")
WRITTEN_AT = re.compile(r"[\x20]{0,2}[\[({<]at[\])}>][\x20]{0,2}", re.I)
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:[\x20]{0,2}(?:[\[({<]dot[\])}>]|\.)[\x20]{0,2}[A-Za-z0-9-]+)+", re.I)
ISSUED = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})\Z")
NEAR = re.compile(r"tel|phone|fax|call|mobile|card|visa|iban|account|konto|compte|cuenta|ssn|passport|mail|contact", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base spans, by kind as listed, then start."""
    found = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool, bool, list[float]]]:
    """Kind, start, end, whether surely private, whether it overlaps a base span, and features."""
    spans: dict[tuple[str, int, int], str] = {}
    if "=" in text or ":" in text:
        for m in NAMED.finditer(text):
            if NAME_PART.search(m[1]):
                spans["secret", *m.span(2)] = m[1].lower()
    for m in TOKEN.finditer(text):
        spans.setdefault(("secret", *m.span()), "")
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            if m.end() - m.start() >= 7:
                spans.setdefault(("number", *m.span()), "")
    for m in WRITTEN_AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:  # brackets are not in LOCAL, so no part is walked twice
            start -= 1
        if start < m.start() and (d := WRITTEN_DOMAIN.match(text, m.end())):
            spans["address", start, d.end()] = ""
    found, base = [], sorted(base, key=lambda b: b[1])
    starts, upto = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    for (kind, start, end), name in sorted(spans.items(), key=lambda x: x[0][1:]):
        before = bisect_left(starts, end)  # base spans that start before the candidate ends
        over = before > 0 and upto[before - 1] > start
        sure = over or name in SURE_NAMES or bool(ISSUED.match(text[start:end])) or kind == "address"
        found.append((kind, start, end, sure, over, features(kind, text, start, end)))
    return found


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 24) : start]
    n = len(span)
    digits = "".join(c for c in span if c in "0123456789")
    upper, lower = sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in span[:200]]
    return [
        float(ADDED.index(kind)), float(min(n, 200)), len(digits) / n, upper / n, lower / n, entropy,
        sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1), float(len(digits)),
        float(16 <= len(digits) <= 19 and luhn(digits)), float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(before[-1:] in "=:" or before[-2:-1] in "=:") if before else 0.0,
        float(before[-1:] in "\"'") if before else 0.0, float(before.endswith("+")), float(bool(NEAR.search(before))),
        float(text[end : end + 1].isalnum()), float("@" in before[-1:]), span.count(".") / n, span.count("-") / n, span.count(" ") / n]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,start:int,end:int>>, further array<struct<kind:string,start:int,end:int,sure:boolean,over:boolean,x:array<double>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, drawn (a hash of the row), the counts, base spans and further candidates of each text."""

    def run(batches):
        span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
        more = pa.struct([*span, ("sure", pa.bool_()), ("over", pa.bool_()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bases, further = [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    bases.append([dict(zip(("kind", "start", "end"), b, strict=True)) for b in base])
                    further.append([dict(zip(("kind", "start", "end", "sure", "over", "x"), c, strict=True)) for c in candidates(text or "", base)])
                counts = [Counter(b["kind"] for b in base) for base in bases]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array(bases, pa.list_(pa.struct(span))), pa.array(further, pa.list_(more))],
                    names=["doc_id", "drawn", *(f"n_{k}" for k in KINDS), "base", "further"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64("text", F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), drawn.alias("drawn")).mapInArrow(run, f"doc_id {kind}, drawn long, {FOUND}")


def learn(scanned: DataFrame):
    """The model and each kind's threshold, from all candidates of all documents; None if they don't have both classes."""
    rows = scanned.select("drawn", F.explode("further").alias("c")).select(
        "drawn", "c.kind", F.col("c.sure").cast("double").alias("label"), array_to_vector("c.x").alias("features"), F.pmod(F.xxhash64("drawn"), F.lit(1000)).alias("part"))
    rows = cut(rows.repartition("drawn").sortWithinPartitions("drawn", "kind"))
    train = rows.filter(F.col("part") >= 1000 * CALIBRATION_SHARE)
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=SEED, stepSize=0.3).fit(train)
    held = model.transform(rows.filter(F.col("part") < 1000 * CALIBRATION_SHARE)).select("kind", "label", F.floor(vector_to_array("probability")[1] * 50).alias("step"))
    steps: dict[str, list] = {}  # at most 51 a kind
    for r in held.groupBy("kind", "step").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        steps.setdefault(r.kind, []).append(r)
    at = dict.fromkeys(ADDED, 0.5)
    for kind, rs in steps.items():
        every, good, n, precise, least = sum(r.good for r in rs), 0, 0, 1.01, None
        for r in rs:  # from the likeliest down
            good, n = good + r.good, n + r.n
            if good >= PRECISION * n:
                precise = r.step / 50
            if least is None and good >= LEAST_RECALL * every:
                least = r.step / 50
        at[kind] = min(precise, least) if every else 1.01
    return model, at


def select_spans(scanned: DataFrame) -> DataFrame:
    """scanned (with row, a unique number) and spans: the base spans and the candidates that pass."""
    learned = learn(scanned)
    each = scanned.filter(F.exists("further", lambda c: ~c["over"])).select("row", F.explode("further").alias("c")).filter("not c.over")
    if learned:
        model, at = learned
        least = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
        judged = model.transform(each.select("row", "c", array_to_vector("c.x").alias("features")))
        each = judged.select("row", "c", vector_to_array("probability")[1].alias("p")).filter(F.col("p") >= least[F.col("c.kind")])
    else:
        each = each.filter("c.sure").withColumn("p", F.lit(1.0))
    span = "struct<start:int,end:int,p:double,kind:string>"
    ordered = F.array_sort(F.collect_list(F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("p"), F.col("c.kind").alias("kind"))))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    out = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    begin = F.struct(F.expr(f"cast(null as {span})").alias("last"), none.alias("kept"))
    better = lambda x, y: (x["p"] > y["p"]) | ((x["p"] == y["p"]) & (x["end"] - x["start"] > y["end"] - y["start"]))

    def sweep(a, x):  # by start, one candidate is held until the next begins behind it
        apart = a["last"].isNull() | (a["last"]["end"] <= x["start"])
        return F.struct(
            F.when(apart | better(x, a["last"]), x).otherwise(a["last"]).alias("last"),
            F.when(apart & a["last"].isNotNull(), F.concat(a["kept"], F.array(out(a["last"])))).otherwise(a["kept"]).alias("kept"))

    best = F.aggregate(ordered, begin, sweep, lambda a: F.concat(a["kept"], F.array(out(a["last"]))))
    added = each.groupBy("row").agg(best.alias("added"))
    return scanned.join(added, "row", "left").withColumn("spans", F.concat("base", F.coalesce("added", none)))


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base and spans (arrays of kind, start, end)."""
    scanned = cut(scan(docs).withColumn("row", F.monotonically_increasing_id()))  # numbers hold once written
    return select_spans(scanned)


def listed(spans, kinds):
    """kind:start:end by kind as given, then start, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars (if there) renewed.

    Overlapping spans are replaced as one, by the name of the first. Texts meet their spans by
    doc_id and content; alike rows get alike spans, so one of their results serves all.
    """
    rows, back = passing(docs, ["doc_id", "text", "n_chars"])
    keyed = rows.withColumn("_content", F.xxhash64("text"))
    scanned = cut(scan(rows.select(F.struct("doc_id", F.xxhash64("text").alias("content")).alias("doc_id"), "text")).withColumn("row", F.monotonically_increasing_id()))
    spans = select_spans(scanned).filter(F.size("spans") > 0).select(
        F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.content").alias("_c"), "spans").groupBy("_id", "_c").agg(F.first("spans").alias("_spans"))
    met = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_id"]) & (keyed["_content"] == spans["_c"]), "left")
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"))
    clean = F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean)
    done = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return back(done)


def op6_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS + ADDED).alias("spans"))
