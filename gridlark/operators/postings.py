"""Posting lists of the header, for many requests at once.

For each level there are its texts, case aside, with the number of variables that have
them, and for each run of one to three characters the texts it is in. A request goes to
the list of its rarest condition alone and has its other conditions checked there, so it
is compared with no more rows than its shortest list has; nothing is compared with the
whole header. By part, a condition stands for the texts that have it in them: its rarest
run names the candidates, and each is looked through.

`HeaderIndex` has the lists as DataFrames, for headers and requests of any size.
`Postings` has them over a header that has been read already (`Dataset.header`).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridlark.model import SimpleVariable, Variable

LEVELS = ("table", "key", "type", "units")
REQUESTS = "req_no long, is_simple boolean, table string, key string, type string, units string"
#: Requests, and what they are sought by, are sent to every task up to this many.
BROADCAST = 100_000
#: About so many rows that a request finds meet it at once; a request goes out once for each such block.
BLOCK = 100_000
_RUN = 3


def request_rows(requests: Sequence[Variable | SimpleVariable]) -> list[tuple]:
    """Rows of REQUESTS; None and levels that a request lacks ask for nothing."""
    text = lambda x: None if x is None else str(x)
    return [(i, isinstance(r, SimpleVariable), *(text(getattr(r, level, None)) for level in LEVELS)) for i, r in enumerate(requests)]


def _runs(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of so many characters."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def _settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """`df` as rows that are known already, if it has no more than BROADCAST."""
    rows = df.limit(BROADCAST + 1).collect()
    few = len(rows) <= BROADCAST
    return df.sparkSession.createDataFrame(rows, df.schema) if few else df, few


@dataclass(frozen=True)
class HeaderIndex:
    """Lists over `variables`. Nulls count as empty texts, as in `lookup.find`. An empty
    header or no request give no rows; requests that repeat find the same rows each.

    Lists, texts and runs can be as large as the header or larger, whatever the bytes of
    the files say that they come from, so joins with them name the other side as the one to
    be broadcast, if that has been counted, and are merge joins else."""

    variables: DataFrame

    @cached_property
    def lists(self) -> DataFrame:
        """`(is_simple, level, text, row)`."""
        levels = F.array(*[F.struct(F.lit(level).alias("level"), F.lower(F.coalesce(F.col(level), F.lit(""))).alias("text")) for level in LEVELS])
        return self.variables.select("is_simple", F.struct("*").alias("row"), F.explode(levels).alias("at")).select("is_simple", "at.level", "at.text", "row")

    @cached_property
    def texts(self) -> DataFrame:
        """`(is_simple, level, text, n)`: the dictionary of each level."""
        return self.lists.groupBy("is_simple", "level", "text").agg(F.count("*").alias("n"))

    @cached_property
    def runs(self) -> DataFrame:
        """`(is_simple, level, run, text, n)`."""
        return self.texts.select("*", F.explode(_runs(F.col("text"), range(1, _RUN + 1))).alias("run"))

    def _having(self, parts: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Texts that have a part in them: `(is_simple, level, part, text, n)`."""
        size = F.length("part")
        run = F.when(size < _RUN, F.array("part")).otherwise(_runs(F.col("part"), [_RUN]))
        on = ["is_simple", "level", "run"]
        asked = parts.select("*", F.explode(run).alias("run"))
        # the number of texts of each run that is asked for; a run of no text leaves with its part
        known = self.runs.groupBy(*on).agg(F.count("*").alias("n_texts"))
        rare = asked.join(known.hint("merge"), on, "left").groupBy("is_simple", "level", "part").agg(F.min(F.struct(F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "run")).alias("r"))
        rare = rare.where("r.n_texts > 0").select("is_simple", "level", "part", "r.run")
        return self.runs.join(small(rare), on).where(F.contains("text", "part")).select("is_simple", "level", "part", "text", "n")

    def find(self, requests: Sequence[Variable | SimpleVariable] | DataFrame, part_match: bool = False) -> DataFrame:
        """`variables` rows with `req_no`, one for each request that they meet. Requests
        are a list, numbered from 0, or a DataFrame of REQUESTS with numbers of its own."""
        if not isinstance(requests, DataFrame):
            few = len(requests) <= BROADCAST
            requests = self.variables.sparkSession.createDataFrame(request_rows(requests), REQUESTS)
        else:
            few = _at_most(requests, BROADCAST)
        dealt = lambda few: F.broadcast if few else lambda df: df.hint("merge")
        # requests of the same conditions are found once; a level not asked for is '', one asked for '=' and its text
        asked = requests.select("req_no", "is_simple", F.array(*[F.coalesce(F.concat(F.lit("="), F.lower(level)), F.lit("")) for level in LEVELS]).alias("want"))
        each, known = _settled(asked.select("is_simple", "want").distinct())
        each = each.withColumn("ask", F.struct("is_simple", "want"))
        if known:  # they go by numbers from here on
            each = each.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(each.select("is_simple", "want").collect())], "is_simple boolean, want array<string>, ask int")
        small = dealt(known)
        parts = F.filter(F.array(*[F.struct(F.lit(x).alias("level"), F.col("want")[i].alias("part")) for i, x in enumerate(LEVELS)]), lambda c: ~c["part"].isin("", "=") if part_match else c["part"] != "")
        parts = F.transform(parts, lambda c: F.struct(c["level"].alias("level"), F.substring(c["part"], F.lit(2), F.length(c["part"])).alias("part")))
        wants = each.select("is_simple", "want", "ask", F.explode(parts).alias("c")).select("is_simple", "want", "ask", "c.*")
        of = ["is_simple", "level", "part"]
        means = self._having(wants.select(*of).distinct(), small) if part_match else self.texts.withColumn("part", F.col("text"))
        # a condition of no text counts as a list of none, which is the shortest
        sizes = means.groupBy(*of).agg(F.sum("n").alias("n"))
        rare = wants.join(sizes.hint("merge"), of, "left").groupBy("is_simple", "want", "ask").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "level", "part")).alias("r"))
        rare = rare.where("r.n > 0").select("is_simple", "want", "ask", "r.level", "r.part")
        if known:
            rare, _ = _settled(rare)
        # each condition is one text, or, by part, as many as have it
        at = means.select(*of, "text").join(small(rare), of).drop("part") if part_match else rare.withColumnRenamed("part", "text")
        meets = F.lit(True)
        for i, level in enumerate(LEVELS):
            low, want = F.lower(F.coalesce(F.col(f"row.{level}"), F.lit(""))), F.col("want")[i]
            meets &= (want == "") | (F.contains(low, F.expr(f"substring(want[{i}], 2)")) if part_match else F.concat(F.lit("="), low) == want)
        at, few_at = _settled(at) if part_match else (at, known)
        found = self.lists.join(dealt(few_at)(at), ["is_simple", "level", "text"]).where(meets).select("ask", "row")
        # those that ask for nothing stand for all; there are at most two for each way to leave a level out
        free = each.where(F.size(parts) == 0).select("is_simple", "ask")
        whole = found.unionByName(self.variables.select("is_simple", F.struct("*").alias("row")).join(F.broadcast(free), "is_simple").select("ask", "row"))
        own = [F.col("row")[c].alias(c) for c in self.variables.columns]
        if few:
            asked = asked.join(small(each), ["is_simple", "want"]).select("req_no", "ask")
            return whole.select("ask", *own).join(F.broadcast(asked), "ask").select(*self.variables.columns, "req_no")
        # a request meets its rows block by block, so that no task holds more of them at once, and comes
        # first, so that its rows are given one after the other; one that finds nothing goes no further
        every = self.variables.groupBy("is_simple").agg(F.count("*").alias("n"))
        counts = found.groupBy("ask").agg(F.count("*").alias("n")).unionByName(free.join(every.hint("merge"), "is_simple").select("ask", "n"))
        counts = counts.select("ask", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        if known:
            counts, _ = _settled(counts)
        asked = asked.join(small(each.join(small(counts), "ask")), ["is_simple", "want"]) if known else asked.withColumn("ask", F.struct("is_simple", "want")).join(small(counts), "ask")
        asked = asked.select("req_no", "ask", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        whole = whole.join(small(counts), "ask").select("ask", F.pmod(F.xxhash64("row.file_id", "row.id"), "blocks").cast("int").alias("block"), *own)
        return asked.hint("merge").join(whole.hint("merge"), ["ask", "block"]).select(*self.variables.columns, "req_no")


class Postings:
    """Lists over header entries on the driver: places in `rows`, which keep their order."""

    def __init__(self, rows: Sequence[Row]):
        self.rows = list(rows)
        self._lists: dict[tuple, dict[str, list[int]]] = {}
        self._every: dict[bool, list[int]] = {True: [], False: []}
        for kind in (True, False):
            for level in LEVELS:
                self._lists[kind, level] = defaultdict(list)
        for i, r in enumerate(self.rows):
            kind = bool(r["is_simple"])
            self._every[kind].append(i)
            for level in LEVELS:
                self._lists[kind, level][(r[level] or "").lower()].append(i)
        self._runs: dict[tuple, dict[str, list[str]]] = {}
        self._known: dict[tuple, dict[str, list[int]]] = {}

    def _having(self, kind: bool, level: str, part: str) -> dict[str, list[int]]:
        """Lists of the texts that have a part in them."""
        if (kind, level, part) not in self._known:
            lists = self._lists[kind, level]
            if (kind, level) not in self._runs:
                self._runs[kind, level] = runs = defaultdict(list)
                for text in lists:
                    for run in {text[i : i + n] for n in range(1, _RUN + 1) for i in range(len(text) - n + 1)}:
                        runs[run].append(text)
            asked = [part] if len(part) < _RUN else [part[i : i + _RUN] for i in range(len(part) - _RUN + 1)]
            texts = min((self._runs[kind, level].get(run, []) for run in asked), key=len)
            self._known[kind, level, part] = {text: lists[text] for text in texts if part in text}
        return self._known[kind, level, part]

    def find(self, request: Variable | SimpleVariable, part_match: bool = False) -> list[Row]:
        """Entries that a request stands for, as `lookup.matches` says, in order."""
        kind = isinstance(request, SimpleVariable)
        wants = [(level, str(v).lower()) for level, v in request._asdict().items() if v is not None and (str(v) or not part_match)]
        if not wants:
            return [self.rows[i] for i in self._every[kind]]
        means = [self._having(kind, *w) if part_match else {w[1]: self._lists[kind, w[0]].get(w[1], [])} for w in wants]
        rare = min(range(len(wants)), key=lambda n: sum(map(len, means[n].values())))
        others = [(level, m) for n, ((level, _), m) in enumerate(zip(wants, means, strict=True)) if n != rare]
        places = sorted(i for places in means[rare].values() for i in places)
        return [r for r in map(self.rows.__getitem__, places) if all((r[level] or "").lower() in m for level, m in others)]
