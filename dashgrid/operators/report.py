"""The outputs of a batch: CSV lines and files, and the text report.

The report's tables are rendered from aggregates over closed domains (modes, fields, rungs, rules), the only
rows that reach the driver. The CSV is written by the executors, its header as a part of its own in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_escape
from ..schemas import FIELDS, RUNGS, TIEBREAKS
from . import stats as A
from . import truth as T

#: The columns of the batch CSV; headings, widths and remarks of the report.
CSV_COLUMNS = ("image", "image_hash", "mode", *(f"{f}{x}" for f in FIELDS for x in ("", "_engine", "_variant", "_stage", "_confidence")),
               "total_ms", "pass1_ms", "ladder_ms", "rungs_ran", "rungs_accepted", "gt_matched", "gt_corrected", *(x for f in FIELDS for x in (f"gt_{f}", f"{f}_correct")))
CSV_HEADER = ",".join(CSV_COLUMNS)
NONE_MATCHED = """
  !! NO IMAGES MATCHED — accuracy cannot be computed.
     Saved readings are matched by image content hash. A picked image
     only matches if that exact file was saved as a reading. Readings
     saved before hashing existed are backfilled from their stored copy;
     if that copy was deleted they can never match."""
BY_FIELD = "%-10s %-16s %-16s %-16s"
RUNG_HEAD, RUNG_LINE = "%-26s %6s %10s %10s  %s", "%-26s %6d %10d %10d  %s"
LEVELS = ("HIGH", "MEDIUM", "LOW")


def csv_line(truth: str = "groundTruth") -> Column:
    """The 31 cells of a batch row; only the name and the rungs are escaped."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    p = lambda f: F.try_element_at("provenance", F.lit(f))
    cells = [csv_escape(text(F.col("imageName"))), text(F.col("imageHash")), text(F.col("mode"))]
    for f in FIELDS:
        cells += [text(F.col(f)), *(text(p(f)[c]) for c in ("engine", "variant", "stage", "confidence"))]
    ran = F.array_join(F.transform("rungEvents", lambda e: e["rung"]), ";")
    won = F.array_join(F.transform(F.filter("rungEvents", lambda e: F.size(e["accepted"]) > 0), lambda e: F.concat(e["rung"], F.lit(":"), F.array_join(F.array_sort(e["accepted"]), "|"))), ";")
    flag = lambda c: F.when(c, "1").otherwise("0")
    gt = F.col(truth)
    cells += [text(F.col("totalMillis")), text(F.col("pass1Millis")), text(F.col("ladderMillis")), csv_escape(text(ran)), csv_escape(text(won))]
    cells += [flag(gt.isNotNull()), F.when(gt.isNull(), "").otherwise(flag(gt["corrected"]))]
    for f in FIELDS:
        cells += [text(gt[f]), F.when(gt[f].isNull(), "").otherwise(flag(F.coalesce(F.col(f) == gt[f], F.lit(False))))]
    return F.concat_ws(",", *cells)


def write_csv(lines: DataFrame, header: str, path: str) -> bool:
    """Writes a column of CSV lines as a folder of text parts, the header being the first; False if it can't be written.

    The parts in the order of their names are the file; no task gathers them.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    head = lines.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    try:
        head.union(lines).write.mode("errorifexists").text(path)
    except (PySparkException, Py4JJavaError):
        return False
    return True


def write_batch_csv(rows: DataFrame, path: str, truth: str = "groundTruth") -> bool:
    return write_csv(rows.select(csv_line(truth).alias("value")), CSV_HEADER, path)


def write_truth_csv(entries: DataFrame, path: str) -> bool:
    return write_csv(T.truth_csv_lines(entries), T.TRUTH_HEADER, path)


def _ratio(hits: int, total: int) -> str:
    return f"{hits}/{total} ({int(hits * 100 / total + 0.5)}%)" if total else "—"


def _by_field(modes: list, cells: dict[tuple, str]) -> list[str]:
    return [BY_FIELD % ("mode", *FIELDS), *(BY_FIELD % (m or "", *(cells.get((m, f), "—") for f in FIELDS)) for m in modes)]


def render(rows: DataFrame, matched: DataFrame, source: str | None) -> str:
    """Counts, matching, fill rates, rungs, engines by variant, merge outcomes, latency and accuracy, as text."""
    m = T.match_summary(matched).first()
    latency = sorted(A.latency(rows).collect(), key=lambda r: r.mode or "")
    modes = [r.mode for r in latency]
    out = [f"IMAGES: {m.images}    RUNS: {sum(r.runs for r in latency)}", T.headline(T.match_summary(matched), source).first().headline]
    if source is not None:
        out += [f"  matched by content hash: {m.by_hash}, by filename: {m.by_name}"] if m.matched else NONE_MATCHED.split("\n")
    fill = {(r.mode, r.field): _ratio(r.filled, r.total) for r in A.fill_rate(rows).collect()}
    out += ["", "(a) FIELD FILL RATE PER MODE", *_by_field(modes, fill)]
    place = {r: i for i, r in enumerate(RUNGS)}
    remark = lambda r: "never ran" if not r.ran else "DEAD — never accepted" if r.is_dead else ""
    rungs = sorted(A.rung_table(rows).collect(), key=lambda r: (place.get(r.rung, len(place)), r.rung or ""))
    out += ["", "(b) RUNG HITS  (ran / produced / accepted)", RUNG_HEAD % ("rung", "ran", "produced", "accepted", ""), *(RUNG_LINE % (r.rung or "", r.ran, r.produced, r.accepted, remark(r)) for r in rungs)]
    won = {(r.variant or "", r.engine or ""): r.accepted for r in A.engine_variant(rows).collect()}
    engines, variants = sorted({e for _, e in won}), sorted({v for v, _ in won})
    out += ["", "(c) ENGINE x VARIANT — accepted values"]
    out += ["%-22s" % "variant" + "".join("%10s" % e for e in engines), *("%-22s" % v + "".join("%10d" % won.get((v, e), 0) for e in engines) for v in variants)] if won else ["  (none)"]
    merged = {(r.field, r.confidence): r.n for r in A.merge_outcomes(rows).collect()}
    out += ["", "(d) MERGE OUTCOMES (BOTH mode)"]
    if merged:
        out += ["%-10s %8s %8s %8s" % ("field", *LEVELS), *("%-10s %8d %8d %8d" % (f, *(merged.get((f, c), 0) for c in LEVELS)) for f in FIELDS if any(k[0] == f for k in merged)), "", "  disagreements settled by:"]
        rule = {t: i for i, t in enumerate(TIEBREAKS)}
        out += ["    %-26s %4d" % (r.tiebreak, r.n) for r in sorted(A.tiebreak_counts(rows).collect(), key=lambda r: (rule.get(r.tiebreak, len(rule)), r.tiebreak))]
    else:
        out.append("  (BOTH mode produced no merged fields)")
    out += ["", "LATENCY (avg ms per run)", "%-10s %10s %10s %10s" % ("mode", "total", "pass1", "ladder"), *("%-10s %10d %10d %10d" % (r.mode or "", r.avg_total, r.avg_pass1, r.avg_ladder) for r in latency)]
    correct = {(r.mode, r.field): _ratio(r.correct, r.compared) for r in A.accuracy(matched).collect()}
    if correct:
        out += ["", f"ACCURACY VS GROUND TRUTH ({m.corrected} corrected, {m.confirmed} as-is)", *_by_field(modes, correct)]
    return "\n".join(out) + "\n"
