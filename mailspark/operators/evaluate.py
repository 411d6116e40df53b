"""Quality against labelled truth: one-to-one matching, recall, precision, auto-push accuracy."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from mailspark.functions.common import casefold, local_day, local_time
from mailspark.operators.rules import DEFAULT_ZONE

_NOBODY = np.zeros(0, np.int64)
_TAKEN = np.iinfo(np.int64).max


def match_truth(candidates: DataFrame, expected: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """(name, cand_ord, exp_ord) of candidates that hit an expected event.

    candidates: name, cand_ord, title, evidence, start_ts. expected: name, exp_ord, title_contains, start_date,
    start_time, tolerance_minutes. A match needs the same local date. The first candidate takes the first expected
    event that fits; rows of one name and number are one candidate, or one event.

    Pairs are never built: both sides of a name pass through one task in their order, where the events that are still
    free wait in queues, one for each wording, day, clock and tolerance. Only these and their numbers are held.
    """
    left = candidates.where(F.col("start_ts").isNotNull()).select(
        "name", F.lit(1).alias("side"), F.col("cand_ord").cast("long").alias("ord"),
        F.unix_date(local_day(F.col("start_ts"), tz)).alias("day"),
        casefold(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("evidence", F.lit("")))).alias("text"),
        (F.hour(local_time(F.col("start_ts"), tz)) * 60 + F.minute(F.col("start_ts"))).cast("double").alias("clock"),
        F.lit(None).cast("double").alias("tolerance"))
    clock = F.split("start_time", ":")
    named = left.schema["name"].dataType
    right = expected.select(
        F.col("name").cast(named).alias("name"), F.lit(0).alias("side"), F.col("exp_ord").cast("long").alias("ord"),
        F.unix_date(F.col("start_date").cast("date")).alias("day"),
        casefold(F.coalesce("title_contains", F.lit(""))).alias("text"),
        (F.get(clock, F.lit(0)).cast("int") * 60 + F.get(clock, F.lit(1)).cast("int")).cast("double").alias("clock"),
        F.greatest(F.coalesce("tolerance_minutes", F.lit(0)), F.lit(0)).cast("double").alias("tolerance"))
    rows = left.unionByName(right).where("name is not null and ord is not null and day is not null")
    return _in_order(rows, ["name", "side", "ord"], _matched, named)


def first_come(pairs: DataFrame) -> DataFrame:
    """(name, cand_ord, exp_ord) that remain where each candidate in its order takes the first expected event left.

    The pairs of a name pass through one task in order; it holds the numbers of the events taken. Equal pairs count once.
    """
    rows = pairs.select("name", "cand_ord", "exp_ord").where("name is not null and cand_ord is not null and exp_ord is not null")
    return _in_order(rows, ["name", "cand_ord", "exp_ord"], _first_left, pairs.schema["name"].dataType)


def _in_order(rows: DataFrame, order: list[str], settle: Callable, named: DataType) -> DataFrame:
    return rows.repartition("name").sortWithinPartitions(*order).mapInArrow(
        settle, f"name {named.simpleString()}, cand_ord long, exp_ord long")


def _out(found: list[tuple], like: pa.Array) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], []]
    return pa.record_batch([pa.array(columns[0], like.type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                           names=["name", "cand_ord", "exp_ord"])


def _first_left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, last, used = None, None, set()
    for batch in batches:
        found = []
        for n, cand, exp in zip(*[c.to_pylist() for c in batch.columns]):
            if n != name:
                name, last, used = n, None, set()
            if cand != last and exp not in used:
                last = cand
                used.add(exp)
                found.append((n, cand, exp))
        yield _out(found, batch.column(0))


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of name, side (0: expected, 1: candidate), ord, day, text, clock, tolerance, sorted by the first three."""
    name, cand, forms, free, like = None, None, [], _Free(), None

    def settled():
        exp = free.take(forms) if forms else None
        return [] if exp is None else [(name, cand, exp)]

    for batch in batches:
        found, like = [], batch.column(0)
        for n, side, ord, day, text, clock, tolerance in zip(*[c.to_pylist() for c in batch.columns]):
            if n != name:
                found += settled()
                name, cand, forms, free = n, None, [], _Free()
            if side == 0:
                free.add(ord, (day, text, clock, tolerance))
            elif free.left:
                if ord != cand:
                    found += settled()
                    cand, forms = ord, []
                forms.append((day, text, clock))
        yield _out(found, like)
    if last := settled():
        yield _out(last, like)


class _Free:
    """The expected events of one name that nobody has taken: the numbers of equal ones (a class) wait in a queue."""

    REMEMBERED = 100_000  # fits of candidates kept for those of the same form

    def __init__(self):
        self.queues: dict[tuple, array] = {}
        self.left, self.newest, self.shared, self.used = 0, None, set(), set()
        self.heads = None

    def add(self, exp: int, kind: tuple) -> None:
        queue = self.queues.setdefault(kind, array("q"))
        if not queue or queue[-1] != exp:
            queue.append(exp)
            self.left += 1
        if exp == self.newest:
            self.shared.add(exp)
        self.newest = exp

    def _open(self) -> None:
        kinds, self.queues = list(self.queues), list(self.queues.values())
        self.heads, self.at, self.fits = np.array([q[0] for q in self.queues], np.int64), [0] * len(kinds), {}
        self.days: dict[int, list] = {}
        for i, kind in enumerate(kinds):
            self.days.setdefault(kind[0], []).append((i, kind[1], np.nan if kind[2] is None else kind[2], kind[3]))
        self.days = {d: (np.array([k[0] for k in ks]), [k[1] for k in ks], *(np.array([k[j] for k in ks]) for j in (2, 3)))
                     for d, ks in self.days.items()}

    def _fitting(self, form: tuple) -> np.ndarray:
        """The classes that fit a candidate, by its day, text and clock."""
        if form not in self.fits:
            if len(self.fits) >= self.REMEMBERED:
                self.fits.clear()
            day, text, clock = form
            where, words, wanted, tolerance = self.days.get(day, (_NOBODY, [], _NOBODY, _NOBODY))
            near = np.flatnonzero(np.isnan(wanted) | (np.abs(wanted - clock) <= tolerance))
            self.fits[form] = where[[k for k in near if words[k] in text]] if len(near) else _NOBODY
        return self.fits[form]

    def take(self, forms: list[tuple]) -> int | None:
        """The first free event that fits any of a candidate's forms."""
        if self.heads is None:
            self._open()
        fits = self._fitting(forms[0]) if len(forms) == 1 else np.unique(np.concatenate([self._fitting(f) for f in forms]))
        while len(fits):
            heads = self.heads[fits]
            k = heads.argmin()
            if heads[k] == _TAKEN:  # nor does a later candidate of these forms find one
                self.fits.update((f, _NOBODY) for f in forms)
                return None
            exp, kind = int(heads[k]), fits[k]
            self.at[kind] += 1
            self.left -= 1
            queue = self.queues[kind]
            self.heads[kind] = queue[self.at[kind]] if self.at[kind] < len(queue) else _TAKEN
            if exp not in self.used:
                if exp in self.shared:
                    self.used.add(exp)
                return exp
        return None


def per_sample(samples: DataFrame, candidates: DataFrame, expected: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of every sample, also of those without candidates or truth."""
    hit = matches.select("name", "cand_ord", F.lit(1).alias("hit"))
    cand = candidates.join(hit, ["name", "cand_ord"], "left").groupBy("name").agg(
        F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("matched"),
        F.count_if("requires_review").alias("review"),
        F.count_if(~F.col("requires_review")).alias("auto_push"),
        F.count_if(~F.col("requires_review") & F.col("hit").isNotNull()).alias("auto_push_correct"))
    exp = expected.groupBy("name").agg(F.count(F.lit(1)).alias("expected"))
    return (samples.select("name").join(cand, "name", "left").join(exp, "name", "left")
            .na.fill(0)
            .select("name", "expected", "candidates", "matched", "auto_push", "auto_push_correct", "review"))


def findings(candidates: DataFrame, expected: DataFrame, matches: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """One row per missed, spurious or wrongly auto-pushed event, and per event found where none was expected."""
    when = F.coalesce(F.date_format(local_time(F.col("start_ts"), tz), "yyyy-MM-dd HH:mm"), F.lit("(无时间)"))
    described = F.concat(F.lit("["), F.col("source"), F.lit("] "), when, F.lit(" "),
                         F.when(F.col("all_day"), "全天").otherwise(""), F.lit(" "), F.substring("title", 1, 40))
    wrong = candidates.join(matches, ["name", "cand_ord"], "left_anti")
    missed = expected.join(matches, ["name", "exp_ord"], "left_anti").select(
        "name", F.lit("missed").alias("finding"),
        F.concat_ws(" ", F.col("start_date").cast("string"), F.coalesce("start_time", F.lit("(无时刻)")),
                    F.concat(F.lit("["), F.col("kind"), F.lit("]")), "title_contains").alias("detail"))
    spurious = wrong.select("name", F.lit("spurious").alias("finding"), described.alias("detail"))
    unsafe = wrong.where(~F.col("requires_review")).select(
        "name", F.lit("auto_push_wrong").alias("finding"), described.alias("detail"))
    false_alarm = candidates.join(expected.select("name").distinct(), "name", "left_anti").select(
        "name", F.lit("false_positive").alias("finding"), described.alias("detail"))
    return missed.unionByName(spurious).unionByName(unsafe).unionByName(false_alarm)


def metrics(samples: DataFrame) -> DataFrame:
    """Recall, precision, F1 and auto-push accuracy over the per-sample counts. An empty denominator gives 1."""
    totals = samples.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "expected", "candidates", "matched", "auto_push", "auto_push_correct")])

    def ratio(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(1.0))

    scored = totals.withColumns({"recall": ratio("matched", "expected"),
                                 "precision": ratio("matched", "candidates"),
                                 "auto_push_accuracy": ratio("auto_push_correct", "auto_push")})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def evaluation_document(samples: DataFrame, found: DataFrame, report_date: Column) -> DataFrame:
    """(report_date, rank, key, ord, line) of an evaluation as Markdown, from per_sample() and findings().

    Ratios, counts, the findings by kind (a kind without findings has no heading) and a table of all samples. key is
    the sample's name; lines of equal name are ordered by their text.
    """
    share = [F.format_string("%.1f%%", F.round(F.col(c) * 100, 1)) for c in ("recall", "precision", "auto_push_accuracy")]

    def row(name: str, value: Column, note: Column) -> Column:
        return F.concat(F.lit(f"| {name} | **"), value, F.lit("** | "), note, F.lit(" |"))

    def item(name: str, column: str) -> Column:
        return F.concat(F.lit(f"- {name}："), F.col(column).cast("string"))

    pushed = F.concat(F.col("auto_push_correct").cast("string"), F.lit("/"), F.col("auto_push").cast("string"), F.lit(" —— 最关键指标"))
    totals = metrics(samples).withColumn("_at", F.lit(1))
    mails = samples.agg(F.count(F.lit(1)).alias("mails")).withColumn("_at", F.lit(1))
    head = totals.join(mails, "_at").select(F.lit(0).alias("rank"), F.lit("").alias("key"), F.posexplode(F.array(
        F.lit("# 抽取质量评估报告"), F.lit(""), F.lit("## 总体指标"), F.lit(""), F.lit("| 指标 | 值 | 说明 |"), F.lit("|---|---|---|"),
        row("召回率", share[0], F.lit("真值事件被抽出的比例（漏识别）")), row("精确率", share[1], F.lit("候选中命中真值的比例（误报）")),
        row("F1", F.format_string("%.3f", F.round("f1", 3)), F.lit("召回与精确的调和平均")), row("自动入历准确率", share[2], pushed),
        F.lit(""), F.lit("## 计数"), F.lit(""), item("语料邮件数", "mails"), item("真值事件数", "expected"),
        item("抽出候选数", "candidates"), item("正确匹配", "matched"), item("可自动入历", "auto_push"), F.lit(""))).alias("ord", "line"))
    kinds = {"false_positive": (1, "## ⚠️ 误报：本不该抽出事件的邮件"), "missed": (2, "## ⚠️ 漏识别：真值中未被抽出的事件"),
             "spurious": (3, "## 多余候选（已在误报中列出，此处按事件展开）"), "auto_push_wrong": (4, "## 🚨 危险的自动入历（会污染日历）")}
    rank, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for kind, (place, text) in kinds.items():
        rank, title = (F.when(F.col("finding") == kind, F.lit(v)).otherwise(other) for v, other in ((place, rank), (text, title)))
    headings = found.select("finding").distinct().select(rank.alias("rank"), F.lit("").alias("key"), F.posexplode(
        F.array(title, F.lit(""))).alias("ord", "line"))
    ends = found.select("finding").distinct().select(  # behind every name
        rank.alias("rank"), F.lit("\U0010ffff").alias("key"), F.lit(0).alias("ord"), F.lit("").alias("line"))
    listed = found.select(rank.alias("rank"), F.col("name").alias("key"), F.lit(0).alias("ord"), F.concat(
        F.lit("- `"), F.col("name"), F.lit("`："), F.coalesce("detail", F.lit(""))).alias("line"))
    table = samples.sparkSession.range(1).select(F.lit(5).alias("rank"), F.lit("").alias("key"), F.posexplode(F.array(
        F.lit("## 逐样本明细"), F.lit(""), F.lit("| 样本 | 真值 | 候选 | 匹配 | 自动入历 | 待审 |"),
        F.lit("|---|---:|---:|---:|---:|---:|"))).alias("ord", "line"))
    figures = ("expected", "candidates", "matched", "auto_push", "review")
    each = samples.select(F.lit(5).alias("rank"), F.col("name").alias("key"), F.lit(0).alias("ord"), F.concat(
        F.lit("| `"), F.col("name"), F.lit("` |"), *[v for c in figures for v in (
            F.lit(" "), F.col(c).cast("string"), F.lit(" |"))]).alias("line"))
    whole = reduce(DataFrame.unionByName, [head, headings, listed, ends, table, each])
    return whole.select(report_date.cast("string").alias("report_date"), "rank", "key", F.col("ord").cast("long").alias("ord"), "line")
