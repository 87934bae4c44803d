"""Main text of HTML pages from streaming parser events.

The standard library's parser gives events, which become lines: the text of one block, with the
number of tags that came with it and the region that it lies in. A region is an element marked as
content (article, main) or as something else (menus, headers, footers, sidebars, notices, adverts,
comments: by tag, role, class or id), or else the outermost container with lines of its own.

Each line, of whatever region, has a ratio: its characters outside links, by its tags. In each
region the ratios are smoothed with a Gaussian, so that a short paragraph between long ones counts
as content, and then weighed by the region's mark. Marks weigh more than ratios differ on most pages, so
they decide where a page has any, and ratios where it has none or where marked regions compete.
Two-means clustering of all lines' weighed ratios sets the threshold, and a region is content if
most of its text lies in lines above it; its lines are then taken whole. If no region passes, the
one with the most weighed text that isn't marked as something else is taken. Only what is never
text for readers (scripts, styles, forms, embedded objects) is left out before.

Edge cases: null and empty pages, and pages of boilerplate only, give an empty text. Unclosed and
wrongly nested elements are read as they come; an element that closes ends those open within it.
Nothing is cut off: very long pages are read whole, and the time is linear in their length, however
deep they nest. Repeated rows are read each; alike regions are decided alike. An empty table gives
no rows. A given column named text gives way to the main text.
"""

import math
import re
from bisect import bisect_left
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quire.llm.common import table

# Elements by what they are for.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section
select summary table tbody td tfoot th thead title tr ul""".split())
NEVER = frozenset("""button canvas embed form head iframe input label map noscript object option script select style
svg template textarea title""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body center dialog div footer header main menu nav section table td".split())
CONTENT = frozenset("article main".split())
OTHER = frozenset("aside dialog footer header menu nav".split())
#: Ends of a paragraph, list item and so on that the markup may leave out.
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|"
    r"gdpr|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|replies|respond|"
    r"share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])", re.I)
ROLES = frozenset("alert banner complementary contentinfo dialog form navigation search".split())

SPACES = re.compile(r"\s+")
PIECE, SIGMA = 1 << 20, 1.0
#: Factors of the ratios in regions marked as content and as something else, and the least threshold.
MARKED, UNMARKED, LEAST = 4.0, 1 / 16, 40.0


class Region:
    def __init__(self, parent: "Region | None", mark: float, marked: bool):
        self.parent, self.mark, self.marked, self.has_lines, self.root = parent, mark, marked, False, None


class Line:
    __slots__ = ("parts", "tags", "chars", "region")

    def __init__(self):
        self.parts, self.tags, self.chars, self.region = [], 0, 0, None


class Lines(HTMLParser):
    """The lines of a page, and its containers in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line()
        self.regions = [Region(None, 1.0, False)]
        # Blocks and what is never text; other elements are counted as tags only.
        self.open: list[tuple[str, bool, Region]] = []
        self.n_open: dict[str, int] = {}
        self.in_link = False

    def state(self) -> tuple[bool, Region]:
        return self.open[-1][1:] if self.open else (False, self.regions[0])

    def end_line(self):
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line()

    def pop(self):
        self.n_open[self.open.pop()[0]] -= 1

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.pop()
        if tag in BLOCKS:
            self.end_line()
        self.line.tags += 1
        if tag == "a":
            self.in_link = True
        if tag in VOID or tag not in BLOCKS and tag not in NEVER:
            return
        out, region = self.state()
        if tag in CONTAINERS:
            named = " ".join(v for k, v in attrs if v and k in ("class", "id"))
            other = tag in OTHER or dict(attrs).get("role") in ROLES or (tag != "body" and tag not in CONTENT and bool(named) and bool(NAMES.search(named)))
            within = region.mark < 1  # what lies in something else is no content, whatever its own tag
            marked = not within and (other or tag in CONTENT)
            region = Region(region, region.mark if not marked else UNMARKED if other else MARKED, marked)
            self.regions.append(region)
        self.open.append((tag, out or tag in NEVER, region))
        self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
            self.in_link = False
        self.line.tags += 1
        if tag == "a":
            self.in_link = False
        if self.n_open.get(tag):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        out, region = self.state()
        if out:
            return
        if not data.isspace():
            self.line.region, region.has_lines = region, True
            self.line.parts.append(data)
            if not self.in_link:
                self.line.chars += len(data)
        elif self.line.parts:
            self.line.parts.append(" ")

    def settle(self):
        """Find what each container belongs to; parents come before their children."""
        for r in self.regions:
            above = r.parent.root if r.parent else None
            r.root = r if r.marked else above or (r if r.has_lines else None)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over the lines, three deviations wide, normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    found = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        found.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return found


def threshold(values: list[float]) -> float:
    """The border between two clusters of the values (two-means on a line); the least value if they are alike."""
    rising = sorted(values)
    sums = [0.0, *accumulate(rising)]
    low, high = rising[0], rising[-1]
    for _ in range(20):
        at = bisect_left(rising, (low + high) / 2)
        if at in (0, len(rising)):
            return rising[0]
        means = sums[at] / at, (sums[-1] - sums[at]) / (len(rising) - at)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parser = Lines()
    for at in range(0, len(page), PIECE):
        parser.feed(page[at : at + PIECE])
    parser.close()
    parser.end_line()
    parser.settle()
    lines = [(text, line.chars / max(1, line.tags), line.region.root) for line in parser.lines if (text := SPACES.sub(" ", "".join(line.parts)).strip())]
    if not lines:
        return ""
    ratios: dict[Region, list[float]] = {}
    for _, ratio, region in lines:
        ratios.setdefault(region, []).append(ratio)
    weighed = {region: iter([v * region.mark for v in smooth(of)]) for region, of in ratios.items()}
    values = [next(weighed[region]) for _, _, region in lines]
    border = max(threshold(values), LEAST)
    mass, weight = dict.fromkeys(ratios, 0), dict.fromkeys(ratios, 0.0)
    for (text, _, region), value in zip(lines, values, strict=True):
        mass[region] += len(text) if value >= border else -len(text)
        weight[region] += len(text) * value
    chosen = {r for r in mass if mass[r] > 0} or set(sorted((r for r in mass if r.mark >= 1), key=lambda r: -weight[r])[:1])
    return " ".join(text for text, _, region in lines if region in chosen)


def extract(pages: DataFrame, columns: list[str]) -> DataFrame:
    """pages' columns and text, the main text of the column html."""
    columns = [c for c in columns if c != "text"]
    out = StructType([*pages.select(*columns).schema.fields]).add("text", StringType())

    def run(batches):
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            for at in range(0, len(source), 500):
                texts = [main_text(page) for page in source.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 500) for c in batch.columns[:-1]), pa.array(texts, pa.string())], names=[*columns, "text"])

    return pages.select(*columns, F.col("html").alias("_html")).mapInArrow(run, out)


def op8_html_extraction(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def oracle() -> str:
    """What the main text of pages is that hold one article of plain blocks, as the given ones do."""
    return r"""
with article as (select page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') as a from pages),
blocks as (select page_id, url, list_transform(string_split_regex(a, '</?(?:p|h1|br|ul|li|div)(?:\s[^>]*)?>'), lambda b:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as b from article)
select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), ' ') as text, length(array_to_string(list_filter(b, lambda x: x <> ''), ' '))::bigint as n_chars from blocks"""
