"""Report sinks: JSON payloads, HTML reports and tables of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pictures
from ..functions import text as t


def strip_private(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore (rasters and the like)."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_json(df: DataFrame, path: str) -> None:
    strip_private(df).write.mode("overwrite").json(path)


def emit(df: DataFrame, json_path: str | None = None, html_path: str | None = None, html: Column | None = None) -> None:
    """One result to several sinks; it is computed once."""
    kept = strip_private(df).persist()
    try:
        if json_path:
            kept.write.mode("overwrite").json(json_path)
        if html_path and html is not None:
            kept.select(html.alias("value")).write.mode("overwrite").text(html_path)
    finally:
        kept.unpersist()


def subtitle(target: Column, question: Column, summary: Column) -> Column:
    """The first that is not empty, escaped, then cut to 200."""
    return F.left(t.escape_html(t.first_truthy(target, question, summary)), F.lit(200))


def meta_cells(values: dict[str, Column]) -> Column:
    """Cells of scalar values; nulls are left out."""
    cells = [F.when(v.isNotNull(), F.concat(F.lit(f"<div class='cell'><b>{name}</b> "), t.escape_html(v.cast("string")), F.lit("</div>"))) for name, v in values.items()]
    return F.concat_ws("", *cells)


def detection_rows(items: Column) -> Column:
    """Table rows of array<struct<box, label, confidence>>: whole-pixel boxes, labels cut to 180."""

    def row(i: Column) -> Column:
        box = F.concat_ws(", ", *[F.rint(i["box"][k]).cast("long").cast("string") for k in ("x1", "y1", "x2", "y2")])
        chip = F.concat(F.lit("<span class='"), t.confidence_band(i["confidence"]), F.lit("'>"), F.coalesce(F.bround(i["confidence"], 2).cast("string"), F.lit("-")), F.lit("</span>"))
        return F.concat(F.lit("<tr><td>"), t.escape_html(F.left(i["label"], F.lit(180))), F.lit("</td><td>"), box, F.lit("</td><td>"), chip, F.lit("</td></tr>"))

    return F.array_join(F.transform(items, row), "")


def report_html(title: Column, sub: Column, cells: Column, rows: Column, raw: Column) -> Column:
    """One self-contained page."""
    return F.concat(
        F.lit("<!doctype html><meta charset='utf-8'><title>"), t.escape_html(title), F.lit("</title><h1>"), t.escape_html(title), F.lit("</h1><p>"), sub,
        F.lit("</p>"), cells, F.lit("<table>"), rows, F.lit("</table><details><summary>Raw</summary><pre>"), t.escape_html(raw), F.lit("</pre></details>"),
    )


def gallery(pages: DataFrame, order: str = "pos", cut: int = 2600) -> DataFrame:
    """One page of cards from (order, title, json); a gallery is a bounded set of demo results."""
    card = F.concat(F.lit("<section><h2>"), t.escape_html(F.col("title")), F.lit("</h2><pre>"), t.escape_html(F.left("json", F.lit(cut))), F.lit("</pre></section>"))
    return pages.select(order, card.alias("card")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "card"))), lambda c: c["card"]), "\n").alias("html"))


def items_of(task: Column, hits: Column, lines: Column, changes: Column, findings: Column, steps: Column) -> Column:
    """The drawable items of a task's result, whichever it is."""
    return F.when(task == "find", hits).when(task == "ocr", lines).when(task == "diff", changes).when(task == "redact", findings).when(task == "guide", steps)


def summary_tables(bench: DataFrame, by: str) -> DataFrame:
    """Long table (variant, group, n, click_accuracy, tight_iou_mean or NaN) of nested summaries keyed by group."""
    rows = bench.select("variant", F.explode(F.col(by)).alias("group", "s"))
    return rows.select("variant", "group", "s.n", "s.click_accuracy", F.coalesce("s.tight_iou_mean", F.lit(float("nan"))).alias("tight_iou_mean"))


def bench_tables(bench: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a benchmark (variant, summary): overall, by kind of box and by role; NaN where no box is tight."""
    nested = bench.select("variant", "summary.*")
    values = ["n", "click_accuracy", "iou_mean", "iou_at_50", "iou_at_75", "tight_iou_mean", "latency_s_median"]
    overall = nested.select("variant", *[F.coalesce(F.col(f"overall.{v}"), F.lit(float("nan"))).alias(v) if v.startswith("tight") else F.col(f"overall.{v}").alias(v) for v in values])
    return {"overall": overall, "by_box_kind": summary_tables(nested, "by_box_kind"), "by_role": summary_tables(nested, "by_role")}


def drawn_screens(screens: DataFrame) -> DataFrame:
    """(id, content): a PNG of each synthetic screen, its elements as frames on white; texts are not drawn."""
    boxes, bands = F.transform("all_elements", lambda e: e["box"]), F.transform("all_elements", lambda e: F.when(e["theme_role"] == "danger", "low").when(e["theme_role"] == "primary", "none").otherwise("medium"))
    return screens.select("id", pictures.blank(F.get("size", F.lit(0)), F.get("size", F.lit(1))).alias("content"), boxes.alias("boxes"), bands.alias("bands")).select("id", pictures.annotate("content", "boxes", "bands").alias("content"))
