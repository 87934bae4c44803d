"""URL filter: host and path rules, then a Bloom filter cascade over listed hosts. [native]

A cascade is a row of Bloom filters. Level 1 encodes the listed keys; level 2 the other keys of
the universe that level 1 lets through by mistake; level 3 the listed keys that level 2 lets
through, and so on until a level makes no mistake on the complete universe. A key is listed if
the first level that does not hold it has an even number. On that universe the answer is exact,
and no page is joined with a list of keys. Keys are split by a hash into parts, so that a cascade may
have any size: each part has its own levels, a few kB of bits that lie beside the rows of that part.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; it
is judged by the cascade like any other host ('' is never listed). Repeated rows are judged each.
An empty universe or an empty list gives a cascade of no levels, which lists nothing. Urls of any
length are read whole; ties between rules cannot occur, as rules that fit one url with equal length
are one rule. Other columns pass through, whatever their names.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, passing, table

#: Host, path prefix, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Host name parts (between dots or hyphens) that mark advertising and tracking.
AD_PARTS = ("ad", "ads", "adserver", "advert", "banner", "click", "clicks", "popup", "sponsor", "track", "tracker", "tracking")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Listed keys in a part, so that a part's words are a few kB at most.
PART_KEYS = 2048
#: Words up to this many bytes are sent along with tasks; more are shuffled to the rows of their parts.
SENT_BYTES = 8 << 20
#: A part with more than 1/PIECES of all rows is hot.
PIECES = 1024


def with_host_path(pages: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path of the column url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def rule_and_verdict(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as host and path in one string, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    number: int
    n_bits: int
    n_hashes: int

    @property
    def name(self) -> str:
        return f"_level_{self.number}"

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * self.number + i)), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def holds(self, key: Column) -> Column:
        held = F.lit(True)
        for at in self.positions(key):
            held = held & (F.getbit(F.get(self.name, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return held


def part_of(key: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n_parts)).cast("int")


@dataclass
class Cascade:
    """filters: _part and an array of 64-bit words for each level; hot: the rows of parts that hold many, in 1/PIECES of all."""

    filters: DataFrame
    n_parts: int
    levels: list[Level] = field(default_factory=list)
    hot: dict[int, int] = field(default_factory=dict)

    def n_bytes(self) -> int:
        return self.n_parts * sum(level.n_bits // 8 for level in self.levels)

    def beside(self, rows: DataFrame, key: Column, most: int = SENT_BYTES) -> DataFrame:
        """rows with the words of their key's part: sent along with tasks up to most bytes, else brought by a
        shuffle on the part, in which a hot part's rows are dealt over several copies of its words."""
        rows = rows.withColumn("_part", part_of(key, self.n_parts))
        if self.n_bytes() <= most:
            return rows.join(F.broadcast(self.filters), "_part")
        copies = F.lit(1)
        for part, n in self.hot.items():  # PIECES of them at most
            copies = F.when(F.col("_part") == part, n).otherwise(copies)
        rows = rows.withColumn("_copy", F.floor(F.rand(0) * copies).cast("int"))
        dealt = self.filters.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        return rows.join(dealt.hint("merge"), ["_part", "_copy"])

    def lists(self, key: Column) -> Column:
        """Whether the key of a row beside its part's words is listed; exact for every key of the universe."""
        said = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            said = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(said)
        return said


def add_level(cascade: Cascade, keys: DataFrame, n_keys: int, rate: float) -> Cascade:
    """cascade with a level more that encodes the column key, with false positives near the given rate.

    Words of all parts have one length; Spark ors their bits together and none come to the driver."""
    per_part = n_keys / cascade.n_parts
    n_bits = 64 * max(1, math.ceil(-per_part * math.log(rate) / math.log(2) ** 2 / 64))
    level = Level(len(cascade.levels) + 1, n_bits, max(1, min(16, round(n_bits / per_part * math.log(2)))))
    spark, n_words = keys.sparkSession, n_bits // 64
    set_bits = keys.select(part_of(F.col("key"), cascade.n_parts).alias("_part"), F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    set_bits = set_bits.select("_part", F.floor(F.col("at") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    unset = spark.range(cascade.n_parts).select(F.col("id").cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(n_words - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.union(unset).groupBy("_part", "word").agg(F.bit_or("bits").alias("bits"))
    filters = words.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select("_part", F.col("w.bits").alias(level.name))
    return Cascade(cut(cascade.filters.join(filters, "_part")), cascade.n_parts, [*cascade.levels, level], cascade.hot)


def build_cascade(universe: DataFrame, part_keys: int = PART_KEYS, most: int = SENT_BYTES) -> Cascade:
    """universe: distinct key, with listed boolean and n (rows of that key), and complete: the answer is exact for these keys.

    The keys are split by a hash into parts of about part_keys listed ones, each with a cascade of its own.
    """
    keys = cut(universe.select("key", "listed", "n"))
    inside = {r.listed: (r.keys, r.rows) for r in keys.groupBy("listed").agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).collect()}  # two rows
    n, n_out = inside.get(True, (0, 0))[0], inside.get(False, (0, 0))[0]
    n_parts = max(1, math.ceil(n / part_keys))
    cascade = Cascade(keys.sparkSession.range(n_parts).select(F.col("id").cast("int").alias("_part")), n_parts)
    if n_parts > 1:
        each = max(1, sum(rows for _, rows in inside.values()) // PIECES)
        crowded = keys.groupBy(part_of(F.col("key"), n_parts).alias("part")).agg(F.sum("n").alias("n")).filter(F.col("n") > each)
        cascade.hot = {r.part: -(-r.n // each) for r in crowded.collect()}  # fewer than 2 * PIECES
    members, others = keys.filter("listed").select("key"), keys.filter("not listed").select("key")
    rate = min(0.5, n * math.sqrt(0.5) / n_out) if n_out else 0.5
    while n:
        cascade = add_level(cascade, members, n, rate)
        passed = cascade.beside(others, F.col("key"), most).filter(cascade.levels[-1].holds(F.col("key"))).select("key")
        members, others = cut(passed), members
        n, rate = members.count(), 0.5
    return cascade


def judge(pages: DataFrame, listed: Column | DataFrame, rules=RULES, part_keys: int = PART_KEYS, most: int = SENT_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to pages; columns of these names are replaced.

    listed: the column host of a table, or a condition on host that marks the listed ones among
    the distinct hosts of pages.
    """
    safe, back = passing(pages, ["url"])
    found = with_host_path(safe)
    universe = found.groupBy("host").agg(F.count("*").alias("n"))
    if isinstance(listed, DataFrame):
        universe = universe.join(listed.select("host").distinct().withColumn("listed", F.lit(True)), "host", "left")
        listed = F.col("listed")
    universe = universe.select(F.col("host").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed"), "n")
    cascade = build_cascade(universe, part_keys, most)
    rule, verdict = rule_and_verdict(rules)
    is_listed = cascade.lists(F.col("host"))
    found = cascade.beside(found, F.col("host"), most).withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow"))})
    return back(found, ("host", "path", "rule", "verdict"))


def ad_host() -> Column:
    """Hosts with a part of AD_PARTS."""
    return F.col("host").rlike(rf"(^|[.-])({'|'.join(AD_PARTS)})([.-]|$)")


def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, ad_host()).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then" for h, p, _ in RULES]
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][0] + RULES[i][1]))
    rule = " ".join(f"{fits[i]} '{RULES[i][0]}{RULES[i][1]}'" for i in order)
    verdict = " ".join(f"{fits[i]} '{RULES[i][2]}'" for i in order)
    return f"""
with rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
found as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from rest)
select page_id, host, path, case {rule} end as rule,
    coalesce(case {verdict} end, case when regexp_matches(host, '(^|[.-])({'|'.join(AD_PARTS)})([.-]|$)') then 'block' else 'allow' end) as verdict
from found"""
