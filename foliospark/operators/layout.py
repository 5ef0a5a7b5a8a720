"""Positioned fragments: reading order, clustering into lines, columns and regions, and classification into elements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ("doc_id", "page_idx")
#: Title font ratio and header / footer zone by extraction profile.
PROFILES = {
    "standard": (1.3, 0.05), "academic": (1.4, 0.08), "form": (1.5, 0.03), "government": (1.3, 0.06), "dense": (1.3, 0.05), "presentation": (1.2, 0.10), "rag": (1.3, 0.05),
}


def once(fragments: DataFrame) -> DataFrame:
    """Each (doc_id, page_idx, seq) once: the table holds exact duplicates."""
    return fragments.dropDuplicates([*PAGE, "seq"])


def gap_groups(df: DataFrame, keys: list[str], value: str, threshold: float | Column, out: str, descending: bool = False) -> DataFrame:
    """Chained clustering: a new group starts where a sorted value is farther than the threshold from the one before."""
    v = F.col(value)
    w = Window.partitionBy(*keys).orderBy(v.desc() if descending else v, "seq")
    step = F.abs(v - F.lag(v).over(w))
    return df.withColumn("_new", F.when(step > threshold, 1).otherwise(0)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def lines(fragments: DataFrame, threshold: float = 5.0) -> DataFrame:
    """line_id (0 at the top) and position in the line, by chained y and then x."""
    g = gap_groups(once(fragments), list(PAGE), "y", threshold, "line_id", descending=True)
    return g.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE, "line_id").orderBy("x", "seq")) - 1)


def body_font(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, body): mode of the font size in half points; ties to the smaller."""
    return once(fragments).groupBy(*PAGE, (F.round(F.col("font_size") * 2) / 2).alias("s")).agg(F.count("*").alias("n")).groupBy(*PAGE).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def zone_confidence(distance: Column, zone: Column) -> Column:
    return F.when(zone <= 0, F.lit(0.5)).otherwise(F.least(F.greatest(distance / zone, F.lit(0.5)), F.lit(1.0)))


def title_confidence(ratio: Column, least: float) -> Column:
    return F.least(F.greatest(F.lit(0.5) + 0.5 * (ratio - least) / least, F.lit(0.5)), F.lit(1.0))


def kv_confidence(key: Column) -> Column:
    n = F.size(T.words(key))
    return F.least(F.greatest(1 - F.octet_length(key) / 40.0 - 0.1 * F.greatest(n - 2, F.lit(0)), F.lit(0.5)), F.lit(1.0))


# Words that begin or stand in sentences, not in labels.
PROSE = (
    "as the this that these those it is was were has have had will would should could may might shall can do does did being been are for with from into about after before during between through "
    "however therefore furthermore moreover although because since while when where which who whom whose according"
).split()


def prose_prefix(key: Column) -> Column:
    """Whether a key reads like a sentence: its first word is one of PROSE, or any word of more than two."""
    words = F.filter(F.split(F.lower(key), r"\s+"), lambda w: w != "")
    prose = F.array(*[F.lit(w) for w in PROSE])
    return F.coalesce(F.array_contains(prose, F.get(words, F.lit(0))), F.lit(False)) | ((F.size(words) > 2) & F.arrays_overlap(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), prose))


def classify(fragments: DataFrame, profile: str = "standard") -> DataFrame:
    """Each fragment with its element type and confidence, by the stages in order: tags, header and footer zones, key-value, title, list item, paragraph."""
    ratio, zone_share = PROFILES[profile]
    f = once(fragments).join(body_font(fragments), list(PAGE))
    t, tag, h = F.col("text"), F.col("struct_tag"), F.col("page_height")
    zone = h * zone_share
    body_tag = F.coalesce(tag.isin("P", "Span", "TD", "TH", "LBody"), F.lit(False))
    short = (F.char_length(t) <= 100) & ~body_tag
    top, bottom = F.col("y") - h * (1 - zone_share), zone - (F.col("y") + F.col("height"))
    key = F.regexp_extract(t, r"^([^:\n]+):\s*\S", 1)
    is_kv = (key != "") & (F.octet_length(key) < 40) & (F.size(T.words(key)) <= 4) & ~key.contains(".") & ~prose_prefix(key)
    big = F.col("font_size") / F.col("body") >= ratio
    bold_short = F.col("is_bold") & (F.char_length(t) <= 120) & ~T.ends_sentence(t) & ~body_tag
    kind = (
        F.when(tag.rlike("^(H[1-6]?|Title)$"), "title").when(tag.isin("LI", "Lbl"), "list_item").when(tag == "Artifact", "artifact")
        .when((top >= 0) & short, "header").when((bottom >= 0) & short, "footer").when(is_kv, "key_value").when(big | bold_short, "title").when(T.is_list_item(t), "list_item").otherwise("paragraph")
    )
    size_ratio = F.col("font_size") / F.col("body")
    confidence = (
        F.when(kind.isin("header"), zone_confidence(top, zone)).when(kind == "footer", zone_confidence(bottom, zone)).when(kind == "key_value", kv_confidence(key))
        .when((kind == "title") & tag.isNull() & big, title_confidence(size_ratio, ratio)).otherwise(F.lit(1.0))
    )
    return f.where(F.trim(t) != "").select(*PAGE, "seq", kind.alias("elem_type"), confidence.alias("confidence"), "text")


def xy_cut(boxes: pd.DataFrame, min_gap: float = 20.0) -> list[int]:
    """Row positions of one page in reading order: the widest vertical gap first, then the widest horizontal one; leaves by y down, x."""
    rows = list(zip(range(len(boxes)), boxes.x, boxes.y, boxes.width, boxes.height))

    def widest(items: list, lo, hi) -> tuple[float, float] | None:
        s = sorted((lo(r), hi(r)) for r in items)
        end, best = s[0][1], None
        for a, b in s[1:]:
            if a - end >= min_gap and (best is None or a - end > best[0]):
                best = (a - end, (a + end) / 2)
            end = max(end, b)
        return best

    out: list[int] = []
    todo = [rows]
    while todo:
        items = todo.pop()
        if len(items) > 1:
            v = widest(items, lambda r: r[1], lambda r: r[1] + r[3])
            if v:
                todo += [[r for r in items if r[1] >= v[1]], [r for r in items if r[1] < v[1]]]
                continue
            g = widest(items, lambda r: r[2], lambda r: r[2] + r[4])
            if g:
                todo += [[r for r in items if r[2] < g[1]], [r for r in items if r[2] >= g[1]]]
                continue
        out += [r[0] for r in sorted(items, key=lambda r: (-r[2], r[1], r[0]))]
    return out


def reading_order_xy(fragments: DataFrame, min_gap: float = 20.0) -> DataFrame:
    """(doc_id, page_idx, seq, pos): order by recursive cuts; one group is one page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        at = xy_cut(pdf, min_gap)
        return pd.DataFrame({"doc_id": pdf.doc_id, "page_idx": pdf.page_idx, "seq": pdf.seq.iloc[at].values, "pos": range(len(at))})

    return once(fragments).select(*PAGE, "seq", "x", "y", "width", "height").groupBy(*PAGE).applyInPandas(run, "doc_id string, page_idx int, seq int, pos int")


def heading_graph(elements: DataFrame) -> DataFrame:
    """(doc_id, elem_seq, parent_seq, prev_seq, next_seq): the latest title before an element with the text of its parent_heading, and its neighbours."""
    e = elements.dropDuplicates(["doc_id", "elem_seq"]).withColumn("heading", F.when(F.col("elem_type") == "title", F.col("text")).otherwise(F.col("parent_heading")))
    title = F.when(F.col("elem_type") == "title", F.col("elem_seq"))
    w = Window.partitionBy("doc_id", "heading").orderBy("elem_seq").rowsBetween(Window.unboundedPreceding, -1)
    doc = Window.partitionBy("doc_id").orderBy("elem_seq")
    return e.select(
        "doc_id", "elem_seq", F.when((F.col("elem_type") != "title") & F.col("heading").isNotNull(), F.last(title, ignorenulls=True).over(w)).alias("parent_seq"),
        F.lag("elem_seq").over(doc).alias("prev_seq"), F.lead("elem_seq").over(doc).alias("next_seq"),
    )


def table_markdown(cells: Column) -> Column:
    """Rows as pipe table: the first is the head, separators as wide as it is; pipes in cells are escaped."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    head = F.element_at(cells, 1)
    sep = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(head), sep), body), "\n"))


def element_markdown(e: str = "elem_type") -> Column:
    """An element's Markdown; null for headers and footers."""
    k, t = F.col(e), F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(k == "title", F.concat(F.lit("# "), t)).when(k == "list_item", F.concat(F.lit("- "), t)).when(k == "key_value", F.concat(F.lit("**"), F.coalesce("kv_key", F.lit("")), F.lit("**: "), F.coalesce("kv_value", F.lit(""))))
        .when(k == "code_block", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(k == "image", F.concat(F.lit("!["), F.coalesce("alt_text", F.lit("")), F.lit("]()"))).when(k == "table", F.coalesce(table_markdown(F.col("table_cells")), F.lit("")))
        .when(k.isin("header", "footer"), F.lit(None).cast("string")).otherwise(t)
    )


def document_markdown(elements: DataFrame) -> DataFrame:
    """(doc_id, page_idx, markdown): the elements of a page in order, joined by blank lines."""
    e = elements.dropDuplicates(["doc_id", "elem_seq"]).withColumn("md", element_markdown()).where("md is not null")
    return e.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))
