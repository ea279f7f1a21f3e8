"""Score a text file or folder: check, build features, predict, publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import quality as Q
from ..operators.row_index import POSITION, with_scan_position
from ..operators.scoring import score_text
from ..schema import MODEL_FEATURES, InputError
from ..session import staged
from ..sources.files import file_rows, inspect_input, read_text
from ..sources.published import Export, publish

_UNREAD = "__unread"


class _BrokenLines(Exception):
    """Some line does not hold a whole row."""


def quarantine(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows fit for scoring with their parsed values, bad rows with the names of the rules they break)."""
    marked = Q.flagged(text, Q.scoring_rules())
    return Q.good_rows(marked), Q.bad_rows(marked)


def with_reasons(bad: DataFrame) -> DataFrame:
    """Bad rows with the names of their broken rules as one text."""
    return bad.withColumn(Q.BROKEN, F.array_join(Q.BROKEN, ","))


def score_file(
    spark: SparkSession, path: str, model, root: str, run: str, strict: bool = True,
    features: Sequence[str] = MODEL_FEATURES, export: bool = False,
) -> int:
    """Score the CSV file or folder ``path`` as run ``run`` under ``root``; returns the number of scored rows.

    Strict: any bad row fails the run with its column and file rows, and nothing becomes
    visible. Otherwise the bad rows go to the output ``quarantine``. Scored rows go to the
    output ``scored`` and, with ``export``, to ``export`` too: CSV in the order of the input.
    ``features`` are the columns the model wants. The run's record keeps what was counted.

    The input is read once: rows and broken rules are counted while the scores are written.
    Files are split by line; if a line turns out not to hold a whole row, because a
    quoted cell goes on in the next one, they are read again, unsplit.
    """
    inspect_input(spark, path)
    try:
        return _score(spark, path, model, root, run, strict, features, export, multi_line=False)
    except _BrokenLines:
        return _score(spark, path, model, root, run, strict, features, export, multi_line=True)


def _score(spark, path, model, root, run, strict, features, export, multi_line: bool) -> int:
    rules, seen = Q.scoring_rules(), Observation()
    text = read_text(spark, path, multi_line=multi_line, unread=_UNREAD)
    if export:
        text = with_scan_position(text)
    broken = [F.count_if(F.array_contains(Q.BROKEN, r.name)).alias(f"rule{i}") for i, r in enumerate(rules)]
    marked = Q.flagged(text, rules).observe(
        seen, F.count("*").alias("rows"), F.count_if(F.col(_UNREAD).isNotNull()).alias("unread"),
        F.count_if(F.size(Q.BROKEN) > 0).alias("broken"), *broken,
    ).drop(_UNREAD)

    def check() -> dict:
        counts = seen.get
        if counts["unread"] and not multi_line:
            raise _BrokenLines
        if not counts["rows"]:
            raise InputError("Input file contains no data rows.")
        if strict and counts["broken"]:
            first = next(i for i in range(len(rules)) if counts[f"rule{i}"])
            _raise_broken(spark, path, rules[first], counts[f"rule{first}"], multi_line)
        named = {r.name: counts[f"rule{i}"] for i, r in enumerate(rules) if counts[f"rule{i}"]}
        return {"rows_read": counts["rows"], "rows_broken": counts["broken"], **named}

    if not strict or export:
        # Several outputs come from rows that are parsed and judged once.
        marked = staged(marked, "flagged")
        if not multi_line and seen.get["unread"]:
            raise _BrokenLines
    scored = score_text(Q.good_rows(marked), model, features=features)
    if export:
        scored = staged(scored, "scored")
    outputs = {"scored": scored.drop(*POSITION)}
    if export:
        outputs["export"] = Export(scored, POSITION)
    if not strict:
        outputs["quarantine"] = with_reasons(Q.bad_rows(marked)).drop(*POSITION)
    return publish(root, outputs, run, check=check)["outputs"]["scored"]["rows"]


def _raise_broken(spark, path, rule: Q.Rule, total: int, multi_line: bool) -> None:
    """The rule's first broken rows are only looked for when there are any."""
    text = with_scan_position(read_text(spark, path, multi_line=multi_line))
    bad = Q.parsed(text).where(rule.condition)
    rows = file_rows(bad, spark, path, multi_line).orderBy("file_row").limit(Q.EXAMPLES_PER_RULE)
    listed = rows.agg(Q.row_list(F.collect_list("file_row"), F.lit(total))).first()[0]
    raise InputError(f"Column {rule.column} has {total} {rule.problem} ({listed}).")
