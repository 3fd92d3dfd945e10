"""Usage kept up to date: states per (event_type, user, day) that batches of events add to, and
roll-ups that merge states and never read events again.

A state is a count, a cost, an HLL sketch of the distinct values of one property and a KLL
sketch of the amounts; all of them merge. A batch writes its states to a folder of its own
and is then committed by one small file that names the folder, so a lost run leaves
nothing that is read, and a batch that is run again changes nothing. Corrections are
batches that count the other way.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.transcripts import MONEY
from scriptorium.operators.usage import TOTAL
from scriptorium.plans.store import drop_path, exists, put_text

KEYS = ("event_type", "user_id", "day")
STATE = "event_type string, user_id long, day date, n long, cost decimal(38,2), kinds binary, amounts binary"
COMMIT = "batch string, folder string, covers array<string>"
#: Sizes of the sketches: a standard error of 1.6 % of a distinct count, and quantiles whose
#: rank is off by 1.3 % at most in 99 of 100.
HLL, KLL = 12, 200


def states_of(events: DataFrame, retract: bool = False) -> DataFrame:
    """The states of a batch. A retraction counts and costs negatively and has no sketches, as
    a sketch can't forget."""
    sign = -1 if retract else 1
    rows = events.select("event_type", "user_id", F.col("ts").cast("date").alias("day"), (F.col("value").cast(MONEY) * sign).alias("cost"), F.get_json_object("props", "$.k").alias("kind"), "value")
    sketches = [F.hll_sketch_agg("kind", F.lit(HLL)).alias("kinds"), F.kll_sketch_agg_double("value", F.lit(KLL)).alias("amounts")]
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("kinds", "amounts")]
    made = rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("n"), F.sum("cost").cast(TOTAL).alias("cost"), *([] if retract else sketches))
    return made.select(*KEYS, "n", "cost", *(nothing if retract else ("kinds", "amounts")))


def merged(states: DataFrame, *by: Column | str) -> DataFrame:
    """States of coarser groups: ``by`` are columns of KEYS or made from them."""
    return states.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum("cost").cast(TOTAL).alias("cost"), F.hll_union_agg("kinds", F.lit(True)).alias("kinds"), F.kll_merge_agg_double("amounts").alias("amounts"))


@dataclass(frozen=True)
class UsageStore:
    """The states under ``path``, in a folder that the cluster shares."""

    spark: SparkSession
    path: str

    def commits(self) -> dict[str, str]:
        """batch -> folder of what is live: a commit that covers others stands for them. One
        small file a batch is read, and :meth:`compact` makes one of many."""
        return {batch: folder for batch, (folder, covered) in self._all().items() if not covered}

    def _all(self) -> dict[str, tuple[str, bool]]:
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema(COMMIT).json(f"{self.path}/commits").collect()
        covered = {b for r in rows for b in r["covers"] or []}
        return {r["batch"]: (r["folder"], r["batch"] in covered) for r in rows} | {b: ("", True) for b in covered - {r["batch"] for r in rows}}

    def _commit(self, batch: str, folder: str, covers: list[str]) -> None:
        put_text(self.spark, f"{self.path}/commits/{batch}.json", json.dumps({"batch": batch, "folder": folder, "covers": covers}))

    def append(self, events: DataFrame, batch: str, retract: bool = False) -> bool:
        """Add a batch of events, told by its name; False if it was there already. Late days are
        states like any others: nothing that was written before is read."""
        if batch in self._all():
            return False
        folder = f"{self.path}/data/{batch}-{uuid.uuid4().hex}"
        states_of(events, retract).write.parquet(folder)
        self._commit(batch, folder, [])
        return True

    def states(self) -> DataFrame:
        """All live states; a key may have one of each batch."""
        folders = sorted(self.commits().values())
        return self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def compact(self) -> None:
        """One folder with one state a key in place of all. The old ones go once it is
        committed; the names of their batches are kept, so that none is added again."""
        live, batch = self.commits(), f"compact-{uuid.uuid4().hex}"
        if len(live) < 2:
            return
        folder = f"{self.path}/data/{batch}"
        merged(self.states(), *KEYS).where("n <> 0 or kinds is not null").write.parquet(folder)
        self._commit(batch, folder, sorted(self._all()))
        for old in live.values():
            drop_path(self.spark, old)

    def cube(self) -> DataFrame:
        """(event_type, user_id, day, n, cost, gid) for every grouping, from the states."""
        fine = self.states().groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).where("n <> 0")
        return fine.cube(*KEYS).agg(F.sum("n").cast("long").alias("n"), F.sum("cost").cast(TOTAL).alias("cost"), F.grouping_id().cast("long").alias("gid"))

    def rollup(self, *by: Column | str) -> DataFrame:
        """(by, n, cost, kinds, p50, p90): distinct kinds and quantiles are estimates. Events that
        were retracted are still in the estimates."""
        rows = merged(self.states(), *by)
        quantile = lambda q: F.kll_sketch_get_quantile_double("amounts", F.lit(q))
        some = F.kll_sketch_get_n_double("amounts") > 0
        return rows.withColumns({"p50": F.when(some, quantile(0.5)), "p90": F.when(some, quantile(0.9)), "kinds": F.hll_sketch_estimate("kinds")}).drop("amounts")
