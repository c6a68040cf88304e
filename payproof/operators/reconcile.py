"""Bank statement against recorded payments, one to one, in three passes: equal amounts, amounts a few cents off,
batch transfers. What is left over is money with no record, or a record with no money.

A pass is greedy in bank order and shares what it used with the next, so lines can only affect each other inside a
cluster: equal amounts whose dates are no further apart than the clearing window, one after the other. Clusters without
names are matched by numbers where they are large, and batch transfers searched one by one in rounds; the other clusters are
folded one after the other, sorted rows in, so that a task holds the payments of one.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import dates, money, screens, text
from payproof.operators.findings import Found, finding
from payproof.scale import checkpointed, components, facts, line_block, running

BANK, PAYMENTS = "bank_statement.csv", "payments.csv"
MATCHED = "dataset_id string, bank_line bigint, pay_line bigint"


@dataclass
class Reconciled:
    bank: DataFrame          # dated statement lines with money out as a positive amount
    exact: DataFrame         # (dataset_id, bank_line, pay_line)
    near: DataFrame
    batch: DataFrame
    unmatched: DataFrame     # money out that no pass explained
    payments: DataFrame
    notes: DataFrame         # (dataset_id, bank_line, note): batch searches that a bound cut short


def statement(bank: DataFrame) -> DataFrame:
    """Dated lines with `out`: money out is positive. DR and CR decide the direction where a file uses them; else minus
    signs do; a file without either lists money out."""
    mark = F.upper(F.regexp_extract("amount_text", r"(?i)(DR|CR)\s*$", 1))
    dated = bank.where("date IS NOT NULL").withColumn("mark", mark)
    style = facts(dated.groupBy("dataset_id").agg(F.bool_or(F.col("mark") != "").alias("marked"), F.bool_or(F.col("amount") < 0).alias("signed")))
    out = (F.when(F.col("marked"), F.abs("amount") * F.when(F.col("mark") == "CR", -1).otherwise(1))
           .when(F.col("signed"), -F.col("amount")).otherwise(F.col("amount")))
    return (dated.join(style, "dataset_id").withColumn("out", out.cast(money.MONEY)).withColumn("cents", money.cents(F.col("out")))
            .withColumn("day", dates.day_number(F.col("date"))).drop("mark", "marked", "signed"))


def _clusters(bank: DataFrame, pays: DataFrame, days: int) -> DataFrame:
    """(dataset_id, cents, day, cluster) for equal amounts: a gap of more than the window starts the next cluster. Runs
    over the distinct days of an amount, never over its lines."""
    key = ["dataset_id", "cents"]
    both = bank.select(*key, "day").distinct().join(pays.select(*key).distinct(), key, "left_semi") \
        .union(pays.select(*key, "day").distinct().join(bank.select(*key).distinct(), key, "left_semi")).distinct()
    w = Window.partitionBy(*key).orderBy("day")
    gap = F.col("day") - F.lag("day").over(w) > days
    return both.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("cluster", F.sum("gap").over(w)).drop("gap")


FOLDED = 10_000                # lines and payments of a cluster that is folded without asking first whether it has names


def _ref() -> Column:
    return F.lower(F.concat("reference", F.lit(" "), "description"))


def _names() -> tuple[Column, Column]:
    return F.lower(text.strip(F.col("payment_id"))), F.lower(text.strip(F.col("invoice_no")))


class Open:
    """Payments of one amount by date and line, some of them taken. `after` leads from each place to the next open one."""

    def __init__(self):
        self.pays, self.days, self.after, self.places = [], [], [0], None

    def add(self, day: int, line: int, pid: str, inv: str) -> None:
        self.pays.append((line, pid, inv))
        self.days.append(day)
        self.after.append(len(self.pays))

    def _open_from(self, i: int) -> int:
        while self.after[i] != i:
            self.after[i] = self.after[self.after[i]]
            i = self.after[i]
        return i

    def _called(self, words: str, start: int, stop: int, which: int) -> Iterator[int]:
        """Places of open payments whose id (0) or invoice (1) is part of the words."""
        if self.places is None:
            self.places = {}, {}
            for i, p in enumerate(self.pays):
                for at, name in zip(self.places, p[1:]):
                    if name:
                        at.setdefault(name, []).append(i)
            self.sizes = [{len(name) for name in at} for at in self.places]
        at = self.places[which]
        for part in {words[i:i + n] for n in self.sizes[which] for i in range(len(words) - n + 1)} & at.keys():
            for i in at[part][bisect_left(at[part], start):bisect_left(at[part], stop)]:
                if self.after[i] == i:
                    yield i

    def give(self, words: str, day: int, days: int) -> int | None:
        """The line of the payment that a bank line takes, if one within the days is open: the earliest, unless the bank line names
        another by its id (counts double) or its invoice."""
        i, stop = self._open_from(bisect_left(self.days, day - days)), bisect_right(self.days, day + days)
        if i >= stop:
            return None
        chosen, named = i, 0
        if words and stop - i > 16:                  # many: looked up by the parts of the words, not one after the other
            first = min(((not (self.pays[j][2] and self.pays[j][2] in words), j) for j in self._called(words, i, stop, 0)), default=None)
            chosen = first[1] if first else min(self._called(words, i, stop, 1), default=i)
            words = ""
        while words and i < stop and named < 3:
            _, pid, inv = self.pays[i]
            says = 2 * bool(pid and pid in words) + bool(inv and inv in words)
            if says > named:
                chosen, named = i, says
            i = self._open_from(i + 1)
        self.after[chosen] = chosen + 1
        return self.pays[chosen][0]


def _fold(width: int, deltas: tuple[int, ...], days: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Match the bank lines of each cluster, in date order, trying the amount differences in turn. Rows come cluster by cluster (the
    first `width` columns), its payments first; only the payments of one cluster are held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_ = None, {}
        for batch in batches:
            rows = []
            for row in zip(*[batch[c].tolist() for c in batch.columns]):
                if row[:width] != at:
                    at, open_ = row[:width], {}
                side, day, line, cents, a, b = row[width:]
                if side == 0:
                    if cents not in open_:
                        open_[cents] = Open()
                    open_[cents].add(day, line, a, b)
                    continue
                offers = (open_[cents + d].give((a or "").strip(), day, days) for d in deltas if cents + d in open_)
                taken = next((x for x in offers if x is not None), None)
                if taken is not None:
                    rows.append((at[0], line, taken))
            yield pd.DataFrame(rows, columns=["dataset_id", "bank_line", "pay_line"])
    return run


def _folded(bank: DataFrame, pays: DataFrame, key: list[str], deltas: tuple[int, ...], days: int) -> DataFrame:
    """`key` begins with dataset_id."""
    pid, inv = _names()
    order = ["side", "day", "line_number", "cents", "a", "b"]
    rows = pays.select(*key, F.lit(0).alias("side"), "day", "line_number", "cents", pid.alias("a"), inv.alias("b")) \
        .union(bank.select(*key, F.lit(1), "day", "line_number", "cents", _ref(), F.lit("")))
    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(_fold(len(key), deltas, days), MATCHED)


def _with_names(bank: DataFrame, pays: DataFrame, key: list[str]) -> DataFrame:
    """Keys of clusters in which a bank line names one of the payments: every part of its words that is as long as an id or invoice
    of the cluster meets those by an equal join. They meet by 64 bits, as there are many parts: a cluster that is taken to have
    names by chance is folded, which gives the same."""
    names = pays.select(*key, F.explode(F.array(*_names())).alias("name")).where("name <> ''").distinct()
    words = bank.select(*key, _ref().alias("ref")).where(F.trim("ref") != "").distinct()
    sizes = names.select(*key, F.length("name").alias("size")).distinct()
    parts = words.join(sizes, key).where(F.length("ref") >= F.col("size")) \
        .select(*key, "ref", "size", F.explode(F.sequence(F.lit(1), F.length("ref") - F.col("size") + 1)).alias("at"))
    parts = parts.select(F.xxhash64(*key, F.substring("ref", F.col("at"), F.col("size"))).alias("h")).distinct()
    return names.withColumn("h", F.xxhash64(*key, "name")).hint("merge").join(parts, "h", "left_semi").select(*key).distinct()


def _walk_days(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each bank day of a cluster: the number of the first payment its lines take, and how many lines get one."""
    for batch in batches:
        rows = []
        for at, days in zip(batch["at"], batch["days"]):
            reached = 0
            for d in days:
                first = max(reached, d["lo"])
                reached = min(first + d["lines"], d["hi"])
                rows.append((at["dataset_id"], at["cents"], at["cluster"], d["day"], first, reached - first))
        yield pd.DataFrame(rows, columns=["dataset_id", "cents", "cluster", "day", "first", "lines"])


def _in_order(bank: DataFrame, pays: DataFrame, key: list[str], days: int) -> DataFrame:
    """Clusters without names: each bank line takes the earliest open payment of its days, so the payments taken are runs of the order
    by date and line. Runs follow from counts by day (a calendar day is one entry, however many lines it has); then lines and payments meet by number."""
    dated = bank.groupBy(*key, "day").agg(F.count("*").alias("lines"), F.lit(0).cast("long").alias("pays")) \
        .union(pays.groupBy(*key, "day").agg(F.lit(0).cast("long").alias("lines"), F.count("*").alias("pays")))
    dated = checkpointed(dated.groupBy(*key, "day").agg(F.sum("lines").alias("lines"), F.sum("pays").alias("pays")))
    w = Window.partitionBy(*key).orderBy("day")
    until = lambda d: F.coalesce(F.sum("pays").over(w.rangeBetween(Window.unboundedPreceding, d)), F.lit(0))
    numbered = dated.select("*", until(-days - 1).alias("lo"), until(days).alias("hi"), until(-1).alias("before"))
    walked = (numbered.where("lines > 0").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("day", "lo", "hi", "lines"))).alias("days"))
              .select(F.struct(*key).alias("at"), "days").mapInPandas(_walk_days, "dataset_id string, cents bigint, cluster bigint, day int, first bigint, lines bigint"))
    level = [("piece", line_block(F.col("line_number")))]
    one = {"place": F.lit(1)}
    lines = running(bank.select(*key, "day", "line_number"), [*key, "day"], level, [F.col("line_number")], one)
    paid = running(pays.select(*key, "day", "line_number"), [*key, "day"], level, [F.col("line_number")], one)
    taking = lines.join(walked, [*key, "day"]).where(F.col("place") < F.col("lines")).select(*key, F.col("line_number").alias("bank_line"), (F.col("first") + F.col("place")).alias("number"))
    given = paid.join(numbered.select(*key, "day", "before"), [*key, "day"]).select(*key, F.col("line_number").alias("pay_line"), (F.col("before") + F.col("place")).alias("number"))
    return taking.join(given, [*key, "number"]).select("dataset_id", "bank_line", "pay_line")


def exact_pass(bank: DataFrame, pays: DataFrame, days: int) -> DataFrame:
    """Equal cents within the clearing window. A cluster of one line and one payment is matched by a join, others of up to
    FOLDED lines and payments are folded. Larger ones in which no line names a payment are matched by numbers; only those with names are
    folded as well."""
    key = ["dataset_id", "cents", "cluster"]
    c = checkpointed(_clusters(bank, pays, days))
    b, p = bank.join(c, ["dataset_id", "cents", "day"]), pays.join(c, ["dataset_id", "cents", "day"])
    sizes = (b.groupBy(*key).agg(F.count("*").alias("nb"), F.min("line_number").alias("bank_line"), F.min("day").alias("bank_day"))
             .join(p.groupBy(*key).agg(F.count("*").alias("np"), F.min("line_number").alias("pay_line"), F.min("day").alias("pay_day")), key))
    sizes = checkpointed(sizes)
    single = sizes.where((F.col("nb") == 1) & (F.col("np") == 1) & (F.abs(F.col("bank_day") - F.col("pay_day")) <= days)) \
        .select("dataset_id", "bank_line", "pay_line")
    several = sizes.where("nb > 1 OR np > 1").select(*key, (F.col("nb") + F.col("np") > FOLDED).alias("large"))
    b, p = checkpointed(b.join(several, key)), checkpointed(p.join(several, key))
    small = _folded(b.where("NOT large"), p.where("NOT large"), key, (0,), days)
    b, p = b.where("large"), p.where("large")
    named = checkpointed(_with_names(b, p, key))
    plain = _in_order(b.join(named, key, "left_anti"), p.join(named, key, "left_anti"), key, days)
    return single.union(small).union(plain).union(_folded(b.join(named, key, "left_semi"), p.join(named, key, "left_semi"), key, (0,), days))


def near_pass(bank: DataFrame, pays: DataFrame, days: int) -> DataFrame:
    """A few cents off. Amounts and days that could meet form a graph over distinct (amount, day) points; its connected
    parts are folded apart from each other."""
    deltas = tuple(sign * d for d in range(1, S.BANK_CENTS + 1) for sign in (-1, 1))
    point = ["dataset_id", "cents", "day"]
    # points meet in pieces as long as the window, of which it touches two at most; what is exploded is never broadcast
    piece = lambda day: F.floor(day / (2 * days + 1))
    asked = (bank.select(*point).distinct().select("dataset_id", F.col("cents").alias("bc"), F.col("day").alias("bd"),
                                                   F.explode(F.array(*[F.col("cents") + d for d in deltas])).alias("cents"))
             .select("*", F.explode(F.array_distinct(F.array(piece(F.col("bd") - days), piece(F.col("bd") + days)))).alias("piece")))
    open_ = pays.select(*point).distinct().withColumn("piece", piece(F.col("day")))
    edges = asked.hint("merge").join(open_, ["dataset_id", "cents", "piece"]).where(F.abs(F.col("day") - F.col("bd")) <= days)

    def node(side: str, c: str, d: str) -> Column:
        return F.concat_ws("|", F.lit(side), "dataset_id", c, d)
    edges = checkpointed(edges.select(node("b", "bc", "bd").alias("a"), node("p", "cents", "day").alias("b")))
    parts = components(edges)
    b = bank.withColumn("node", node("b", "cents", "day")).join(parts, "node")
    p = pays.withColumn("node", node("p", "cents", "day")).join(parts, "node")
    return _folded(b, p, ["dataset_id", "component"], deltas, days)


# ---------------------------------------------------------------- batch transfers
def _subsets(cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and size of every subset; bit 0 of a subset's number stands for the last amount, so that of two subsets the one that goes on
    with an earlier amount has the larger number."""
    total, size = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for c in cents[::-1]:
        total, size = np.concatenate([total, total + c]), np.concatenate([size, size + 1])
    return total, size


def pick_sum(pool: list[tuple[int, int]], target: int, most: int) -> list[int] | None:
    """Lines of 2 to `most` payments (line, cents) that add up to the target. Of several such sets the one with the smallest amount,
    then the smallest second one, and so on; equal amounts in the order given.

    The subsets of one half of the sorted amounts are looked up among the other's: at most 2**20 each, all of
    them, so that a set is found whenever there is one."""
    items = sorted((x for x in pool if 0 < x[1] <= target), key=lambda x: x[1])
    if target <= 0 or len(items) < 2:
        return None
    got = _halved([c for _, c in items], target, 2, most)
    return got and [items[i][0] for i in got]


def _halved(amounts: list[int], target: int, least: int, most: int) -> list[int] | None:
    """Places of the first set of `least` to `most` of the sorted amounts, by the sums of the subsets of each half."""
    cents, half = np.array(amounts, np.int64), len(amounts) // 2
    (head, head_size), (tail, tail_size) = _subsets(cents[:half]), _subsets(cents[half:])
    fits = np.flatnonzero((head <= target) & (head_size <= most))
    fits = fits[np.isin(target - head[fits], tail)]
    if not len(fits):
        return None
    order = np.argsort(tail, kind="stable")
    sums = tail[order]
    # subsets alike in sum and size have the same chances: of each kind only the first in order is tried
    _, place = np.unique(np.stack([head[fits[::-1]], head_size[fits[::-1]]], 1), axis=0, return_index=True)
    for at in np.sort(place):
        first = fits[::-1][at]                       # the larger the number, the smaller its first amounts
        lo, hi = np.searchsorted(sums, [target - head[first], target - head[first] + 1])
        size = head_size[first] + tail_size[order[lo:hi]]
        rest = order[lo:hi][(size >= least) & (size <= most)]
        if len(rest):
            chosen = int(first) << (len(amounts) - half) | int(rest.max())
            return [i for i in range(len(amounts)) if chosen >> (len(amounts) - 1 - i) & 1]
    return None


def _begins(amounts: list[int], start: int, stop: int, target: int) -> int | None:
    """The first place from `start` on with which a set of the places up to `stop` that adds up to the target can begin. Bit r of `left`
    says that a set of the places seen so far leaves r of the target."""
    left, first = 1 << target, None
    for i in range(stop - 1, start - 1, -1):
        less = left >> amounts[i]
        if less & 1:
            first = i
        left |= less
    return first


def any_sum(pool: list[tuple[int, int]], target: int) -> list[int] | None:
    """What `pick_sum` finds with no bound on the pool or the set.

    Sets that take the smallest amounts, as many as can be, come before all others. How many can be is looked for from the
    largest number down, in growing steps and then halving the last: with few taken away little of the target is open, and of a
    large pool that little is nearly always made up. Then the next amount is taken with which a set can begin, and so on. What is
    open is looked for among all sums, as bits of a number, or by halves where few amounts are left."""
    items = sorted((x for x in pool if 0 < x[1] < target), key=lambda x: x[1])
    unit = gcd(*[c for _, c in items])
    if not items or target % unit:
        return None
    cents, open_ = [c // unit for _, c in items], target // unit
    got, start = [], 0
    while open_:
        stop = bisect_right(cents, open_)
        n = stop - start
        if n <= 44 and 20 << (n + 1) // 2 <= n * open_ // 15:
            rest = _halved(cents[start:stop], open_, 1, n) if n > 0 else None
            return None if rest is None else [items[i][0] for i in got] + [items[start + i][0] for i in rest]
        sums = [0, *accumulate(cents[start:stop])]
        if sums[-1] < open_:
            return None

        def after(k: int) -> int | None:
            """Where a set goes on that takes the k smallest: `stop` if they are all of it."""
            rest = open_ - sums[k]
            return _begins(cents, start + k, bisect_right(cents, rest, start + k, stop), rest) if rest else stop
        no = bisect_right(sums, open_)               # more than can be taken
        yes, at, step = no - 1, after(no - 1), 1
        while at is None and yes:
            no, yes = yes, max(0, yes - step)
            at, step = after(yes), 2 * step
        if at is None:
            return None
        while no - yes > 1:
            k = (yes + no) // 2
            if (found := after(k)) is None:
                no = k
            else:
                yes, at = k, found
        got += range(start, start + yes)
        open_ -= sums[yes]
        if open_:
            got.append(at)
            open_ -= cents[at]
        start = at + 1
    return [items[i][0] for i in got]


def _picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The payments that each debit pays; where a bound cut its search short and nothing was found, a note instead."""
    for batch in batches:
        rows = []
        for dataset_id, line, cents, room, most, pool in zip(*[batch[c] for c in ("dataset_id", "bank_line", "cents", "room", "most", "pool")]):
            whole = pd.isna(room)
            items = [(x["pay_line"], x["pay_cents"]) for x in (pool if whole else pool[:int(room)])]
            got = any_sum(items, cents) if whole else pick_sum(items, cents, most)
            if got:
                rows += [(dataset_id, line, x, None) for x in got]
            elif whole:
                continue
            elif len(pool) > room:
                rows.append((dataset_id, line, None, f"more than {int(room)} open payments"))
            elif len(items) > most and pick_sum(items, cents, len(items)):
                rows.append((dataset_id, line, None, f"a set of more than {int(most)} payments"))
        yield pd.DataFrame(rows, columns=["dataset_id", "bank_line", "pay_line", "note"]).astype({"pay_line": "Int64"})


def _pools(bank: DataFrame, pays: DataFrame, days: int, limits: dict) -> DataFrame:
    """A row for each debit and open payment that it may pay: of a batch transfer all payments of its days, of another line
    those of suppliers that it names (its parts of as many words as a supplier's name has meet the name by equality)."""
    desc = F.concat("description", F.lit(" "), "reference")
    batch = screens.is_batch(F.col("description"), F.col("reference"))
    b = bank.where("cents > 0").select("dataset_id", F.col("line_number").alias("bank_line"), "day", "cents", batch.alias("batch"), text.norm_name(desc).alias("named"))
    each_day = F.explode(F.sequence(F.col("day") - days, F.col("day"))).alias("pay_day")
    p = pays.where("cents > 0").select("dataset_id", F.col("day").alias("pay_day"), F.col("line_number").alias("pay_line"), F.col("cents").alias("pay_cents"),
                                       text.norm_name(F.col("supplier")).alias("sup"))
    runs = b.where("batch").drop("named").select("*", each_day).hint("merge").join(p.drop("sup"), ["dataset_id", "pay_day"])
    firms = p.where("sup <> ''")
    lengths = facts(firms.groupBy("dataset_id").agg(F.collect_set(F.size(F.split("sup", " "))).alias("lengths")))
    words = F.split("named", " ")
    parts = F.transform(F.filter("lengths", lambda n: n <= F.size(words)), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.array_join(F.slice(words, at, n), " ")))
    named = b.where("NOT batch").join(lengths, "dataset_id").select(*b.columns, F.explode(F.array_distinct(F.flatten(parts))).alias("sup"))
    named = named.hint("merge").join(firms.select("dataset_id", "sup").distinct(), ["dataset_id", "sup"], "left_semi")
    own = named.select("*", each_day).hint("merge").join(firms, ["dataset_id", "pay_day", "sup"])
    bound = lambda name: F.when(F.col("batch"), limits[f"batch_{name}"]).otherwise(limits[f"named_{name}"]).cast("int").alias({"pool": "room", "max": "most"}[name])
    found = runs.unionByName(own.drop("named", "sup"))
    return found.select("dataset_id", "bank_line", "day", "cents", "pay_day", "pay_line", "pay_cents", bound("pool"), bound("max"))


def _searched(pools: DataFrame, limits: dict) -> DataFrame:
    """(dataset_id, bank_line, pay_line, note) of each debit, searched on its own among the payments of its pool, latest first; where its
    kind has a bound, among the latest."""
    latest = Window.partitionBy("dataset_id", "bank_line").orderBy(F.col("pay_day").desc(), F.col("pay_line").desc())
    pools = pools.withColumn("place", F.row_number().over(latest)).where(F.col("room").isNull() | (F.col("place") <= F.col("room") + 1))
    one = pools.groupBy("dataset_id", "bank_line", "cents", "room", "most").agg(F.array_sort(F.collect_list(F.struct("place", "pay_line", "pay_cents"))).alias("pool"))
    # a search is long for the few bytes of its pool: a number of partitions that is asked for isn't made smaller
    one = one.repartition(int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dataset_id", "bank_line")
    return one.mapInPandas(_picked, "dataset_id string, bank_line bigint, pay_line bigint, note string")


def batch_pass(bank: DataFrame, pays: DataFrame, days: int, limits: dict | None = None) -> DataFrame:
    """Debits that pay several open payments at once: (dataset_id, bank_line, pay_line, note), a note where a bound of `limits` cut a search
    that found nothing.

    Debits are worked off in order, each without what earlier ones took. All are searched at once; those with a payment in their pool that an
    earlier one now takes are searched again without it, until nothing changes. The first debit is right from the start,
    and one is right when all that it depends on are, so what no longer changes is what working them off in order gives. What is
    held together is one debit's pool: its bound, or without one the open payments of its days."""
    limits = S.limits_with(limits)
    if any((limits[f"{kind}_pool"] is None) != (limits[f"{kind}_max"] is None) for kind in ("batch", "named")):
        raise ValueError("a pool and its sets are bounded both or neither")
    debit = ["dataset_id", "bank_line"]
    pools = checkpointed(_pools(bank, pays, days, limits))
    found, seen = checkpointed(_searched(pools, limits)), None
    days_of = pools.select(*debit, F.col("day").alias("taker_day")).distinct()
    while True:
        takers = found.where("pay_line IS NOT NULL").join(days_of, debit).select("dataset_id", "pay_line", F.col("bank_line").alias("taker"), "taker_day")
        gone = pools.join(takers, ["dataset_id", "pay_line"]).where("taker_day < day OR (taker_day = day AND taker < bank_line)").select(*debit, "pay_line").distinct()
        gone = checkpointed(gone)
        marks = gone.groupBy(*debit).agg(F.count("*").alias("n"), F.sum(F.xxhash64("pay_line").cast("decimal(38,0)")).alias("h"))
        marks = checkpointed(marks)
        changed = marks.select(*debit) if seen is None else marks.exceptAll(seen).select(*debit).union(seen.exceptAll(marks).select(*debit)).distinct()
        changed = checkpointed(changed)
        if changed.isEmpty():
            return found
        again = _searched(pools.join(changed, debit, "left_semi").join(gone, [*debit, "pay_line"], "left_anti"), limits)
        found, seen = checkpointed(found.join(changed, debit, "left_anti").union(again)), marks


def _without(df: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    return df.join(matched.select("dataset_id", F.col(side).alias("line_number")).distinct(), ["dataset_id", "line_number"], "left_anti")


def prepared(bank: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statement lines, those that can be supplier payments, dated payments of datasets that have a statement)."""
    lines = checkpointed(statement(bank))
    todo = lines.where(~((F.col("out") > 0) & screens.non_supplier_bank(F.col("description"), F.col("reference"))))
    pays = checkpointed(payments.where("pay_date IS NOT NULL").select(
        "dataset_id", "line_number", "payment_id", "supplier", "invoice_no", "pay_date", "paid_amount", money.cents(F.col("paid_amount")).alias("cents"),
        dates.day_number(F.col("pay_date")).alias("day")).join(facts(lines.select("dataset_id").distinct()), "dataset_id", "left_semi"))
    return lines, todo, pays


def one_to_one(bank: DataFrame, payments: DataFrame, limits: dict) -> Reconciled:
    """The first two passes: `unmatched` and `payments` are what they leave to the batch transfers."""
    days = limits["bank_days"]
    lines, todo, pays = prepared(bank, payments)
    exact = checkpointed(exact_pass(todo, pays, days))
    left, open_ = checkpointed(_without(todo, exact, "bank_line")), checkpointed(_without(pays, exact, "pay_line"))
    near = checkpointed(near_pass(left.where(~screens.is_batch(F.col("description"), F.col("reference"))), open_, days))
    left, open_ = checkpointed(_without(left, near, "bank_line").where("out > 0")), checkpointed(_without(open_, near, "pay_line").where("paid_amount > 0"))
    none = left.limit(0)
    return Reconciled(lines, exact, near, none.select("dataset_id", F.lit(0).alias("bank_line"), F.lit(0).alias("pay_line")), left, open_, none.select("dataset_id", F.lit(0).alias("bank_line"), F.lit("").alias("note")))


def with_batches(r: Reconciled, limits: dict) -> Reconciled:
    """The batch transfers among what `one_to_one` left."""
    searched = batch_pass(r.unmatched, r.payments, limits["bank_days"], limits)
    batch, notes = searched.where("pay_line IS NOT NULL").drop("note"), searched.where("note IS NOT NULL").drop("pay_line")
    return replace(r, batch=batch, unmatched=_without(r.unmatched, batch, "bank_line"), payments=_without(r.payments, batch, "pay_line"), notes=notes)


def reconcile(bank: DataFrame, payments: DataFrame, limits: dict) -> Reconciled:
    return with_batches(one_to_one(bank, payments, limits), limits)


def bank_without_record(r: Reconciled) -> Found:
    """5.5 (High): money that left with no recorded payment."""
    title = F.concat(F.lit("Bank payment of $"), money.fmt(F.col("out")), F.lit(" on "), F.col("date").cast("string"), F.lit(" ("),
                     text.strip(F.col("description")), F.lit(") has no recorded payment"))
    return Found(finding(r.unmatched, "Payments", "5.5", "High", F.col("out"), title, BANK))


def payment_not_on_statement(r: Reconciled, limits: dict) -> Found:
    """5.5 (Low): a recorded payment the statement, within the dates it covers, does not show."""
    covers = facts(r.bank.groupBy("dataset_id").agg(F.min("day").alias("first"), F.max("day").alias("last")))
    hit = r.payments.join(covers, "dataset_id").where((F.col("day") >= F.col("first")) & (F.col("day") + limits["bank_days"] <= F.col("last")))
    title = F.concat(F.col("payment_id"), F.lit(" ($"), money.fmt(F.col("paid_amount")), F.lit(" to "), F.col("supplier"), F.lit(") is not on the bank statement"))
    return Found(finding(hit, "Payments", "5.5", "Low", F.col("paid_amount"), title, PAYMENTS))
