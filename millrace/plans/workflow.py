"""Steps with a log, undo, quarantine, checkpoints and audit.

A table's state is a plan, so history keeps plans and copies nothing. Quarantined rows are a table with the row as JSON.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import missing_share
from ..operators.rows import schema_changes
from .result import HARD_STOP, HardStop, StepResult

LOG_SCHEMA = "id int, at timestamp, phase string, operation string, parameters string, columns_before int, columns_after int, quarantined long, status string, error string"
QUARANTINE_SCHEMA = "stage string, reason string, failed_column string, row_data string, resolution string"


def quarantine_rows(bad: DataFrame, stage: str, reason: str, column: str | None = None) -> DataFrame:
    return bad.select(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"), F.lit(column).alias("failed_column"), F.to_json(F.struct(*bad.columns)).alias("row_data"), F.lit("pending").alias("resolution"))


# Families of transformations, by words of their names.
FAMILIES = {"log": ["log"], "sqrt": ["square root", "sqrt"], "normalize": ["normalize", "0-1"], "standardize": ["standardize", "z-score"], "reciprocal": ["reciprocal"], "cube_root": ["cube root", "cube_root"], "dtype→numeric": ["dtype→numeric"], "dtype→category": ["dtype→category"]}


@dataclass
class TransformRegistry:
    """Which transformations columns have had, so that the same kind isn't stacked on itself unnoticed."""

    done: dict[str, list[str]] = field(default_factory=dict)

    def register(self, col: str, name: str) -> list[str]:
        """Earlier transformations of col of the same family; the new one is noted in any case."""
        family = lambda n: next((k for k, words in FAMILIES.items() if any(w in n.lower() for w in words)), n)
        before = [n for n in self.done.get(col, []) if family(n) == family(name)]
        self.done.setdefault(col, []).append(name)
        return before

    def apply(self, df: DataFrame, col: str, name: str, step, force: bool = False) -> DataFrame:
        """step(df), unless col has had a transformation of the same family: then df as it is, and nothing is noted."""
        if not force and TransformRegistry({col: self.done.get(col, [])[:]}).register(col, name):
            return df
        self.register(col, name)
        return step(df)


@dataclass
class Snapshot:
    """What a table looked like: counts, share of nulls, an order-free hash, and its schema."""

    rows: int
    columns: int
    null_pct: float
    digest: str
    schema: list[tuple[str, str]]


def row_digest(df: DataFrame) -> str:
    """16 hex digits that depend on the rows, repeated ones included, and not on their order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    one = df.agg(F.sum(F.pmod(h, F.lit(1_000_000_007)).cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{one['s']} {one['x']} {one['n']}".encode()).hexdigest()[:16]


def snapshot(df: DataFrame) -> Snapshot:
    shares = missing_share(df)
    return Snapshot(df.count(), len(df.columns), 100 * sum(shares.values()) / max(len(shares), 1), row_digest(df), df.dtypes)


@dataclass
class Workflow:
    """A table under work. Every step takes and gives a DataFrame, or a StepResult."""

    df: DataFrame
    most: int = 50
    states: list[tuple[str, DataFrame]] = field(default_factory=list)
    at: int = 0
    log: list[dict] = field(default_factory=list)
    pending: DataFrame | None = None
    checkpoint: Snapshot | None = None
    transforms: TransformRegistry = field(default_factory=TransformRegistry)

    def __post_init__(self) -> None:
        self.raw = self.df
        self.states = [("import", self.df)]

    def apply(self, name: str, step: Callable[..., DataFrame | StepResult], *args, phase: str = "", **kw) -> StepResult:
        """A hard stop is logged and leaves the table."""
        before = self.df
        try:
            got = step(before, *args, **kw)
            result = got if isinstance(got, StepResult) else StepResult(got)
        except HardStop as e:
            result = StepResult(before, failure=HARD_STOP, error=str(e))
        if result.failure != HARD_STOP:
            self.df = result.df
            self.states = [*self.states[: self.at + 1], (name, result.df)][-self.most :]
            self.at = len(self.states) - 1
            if result.quarantine is not None:
                self.pending = result.quarantine if self.pending is None else self.pending.unionByName(result.quarantine)
        n = result.quarantine.count() if result.quarantine is not None else 0
        self.log.append({"id": len(self.log), "at": datetime.now(UTC).replace(tzinfo=None), "phase": phase, "operation": name, "parameters": json.dumps([args, kw], default=str), "columns_before": len(before.columns), "columns_after": len(self.df.columns), "quarantined": n, "status": result.failure or "success", "error": result.error})
        return result

    def _go(self, by: int) -> bool:
        if not 0 <= self.at + by < len(self.states):
            return False
        self.at += by
        self.df = self.states[self.at][1]
        return True

    def undo(self) -> bool:
        if done := self._go(-1):
            last = next((r for r in reversed(self.log) if r["status"] == "success"), None)
            if last:
                last["status"] = "undone"
        return done

    def redo(self) -> bool:
        if done := self._go(1):
            last = next((r for r in self.log if r["status"] == "undone"), None)
            if last:
                last["status"] = "success"
        return done

    def log_table(self) -> DataFrame:
        names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        return self.df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in self.log], LOG_SCHEMA)

    def take_checkpoint(self) -> Snapshot:
        self.checkpoint = snapshot(self.df)
        return self.checkpoint

    def resolve(self, how: str) -> None:
        """Pending rows are dropped, or force-included by name with what of them fits the present schema."""
        if self.pending is None:
            return
        if how == "include":
            rows = self.pending.select(F.from_json("row_data", self.df.schema).alias("r")).select("r.*")
            self.df = self.df.unionByName(rows, allowMissingColumns=True)
            self.states.append(("include quarantined", self.df))
            self.at = len(self.states) - 1
        self.pending = None

    def may_export(self) -> bool:
        return self.pending is None or not self.pending.limit(1).count()

    def audit(self) -> dict:
        """Changes since the checkpoint (or the import), and whether rows grew by over half."""
        before, now = self.checkpoint or snapshot(self.raw), snapshot(self.df)
        kept = self.pending.count() if self.pending is not None else 0
        return {"rows": now.rows - before.rows, "columns": now.columns - before.columns, "null_pct": now.null_pct - before.null_pct, "changed": now.digest != before.digest, "grown": now.rows > 1.5 * before.rows, "quarantined": kept, "dropped": max(0, before.rows - now.rows - kept), **schema_changes(self.raw, self.df)}
