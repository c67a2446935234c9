"""The line budget of a source tree: a state that is read, compared and set in numbered versions, of which two writers can't both make the next."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import token_line_counts


class BudgetError(ValueError):
    """The budget is reached, its state isn't valid, or another writer was first."""


@dataclass(frozen=True)
class Budget:
    """checkpoints: (threshold, commit, time), the last one counts; the next threshold is `growth` above it unless `override` says another one, which
    is pending until the tree is `reduction` lines below it."""

    directories: tuple[str, ...]
    extensions: tuple[str, ...]
    growth: int
    reduction: int
    checkpoints: tuple[tuple[int, str, str], ...]
    override: int | None = None

    def __post_init__(self):
        whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
        texts = lambda xs: all(isinstance(x, str) for x in xs)
        fine = texts(self.directories) and texts(self.extensions) and whole(self.growth, 1) and whole(self.reduction, 1) and self.checkpoints and whole(self.checkpoints[-1][0], 0)
        if not fine or not (self.override is None or whole(self.override, 0)):
            raise BudgetError("the budget has an unsupported shape")

    @property
    def threshold(self) -> int:
        return self.checkpoints[-1][0] + self.growth if self.override is None else self.override

    @property
    def target(self) -> int:
        return self.threshold - self.reduction


def budget_lines(texts: DataFrame, budget: Budget) -> int:
    """Lines with tokens of the files of texts(file, text) in the budget's directories, of its extensions."""
    inside = F.lit(False)
    for d in budget.directories:
        inside = inside | F.col("file").startswith(d.rstrip("/") + "/") if d not in ("", ".") else F.lit(True)
    ending = F.regexp_extract("file", r"(\.[^./]*)$", 1).isin(*budget.extensions)
    return token_line_counts(texts.where(inside & ending)).agg(F.sum("lines").alias("n")).first()["n"] or 0


class BudgetLedger:
    """A folder of states, budget-000001.json and so on; each is written once, by whoever makes the file first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._store.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self._store.listStatus(self._path(""))]
        return sorted(int(n[7:-5]) for n in names if n.startswith("budget-") and n.endswith(".json"))

    def read(self) -> tuple[int, Budget]:
        """The newest version and its number."""
        versions = self._versions()
        if not versions:
            raise BudgetError("there is no budget")
        stream = self._store.open(self._path(f"budget-{versions[-1]:06d}.json"))
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise BudgetError("the budget can't be read") from e
        finally:
            stream.close()
        if not isinstance(told, dict) or told.pop("version", None) != 1:
            raise BudgetError("the budget has an unsupported shape")
        try:
            return versions[-1], Budget(**{k: tuple(map(tuple, v)) if k == "checkpoints" else tuple(v) if isinstance(v, list) else v for k, v in told.items()})
        except TypeError as e:
            raise BudgetError("the budget has an unsupported shape") from e

    def write(self, after: int, budget: Budget) -> int:
        """Set the state that follows version `after`, unless another writer has set it: then an error, and nothing is lost."""
        name = f"budget-{after + 1:06d}.json"
        data = json.dumps({"version": 1} | {k: v for k, v in asdict(budget).items() if v is not None}, indent=2) + "\n"
        self._store.mkdirs(self._path(""))
        try:
            if self._store.getUri().getScheme() == "file":
                # The local file system's own exclusive creation; others create exclusively by themselves.
                at = os.open(self._path(name).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
                with os.fdopen(at, "w") as f:
                    f.write(data)
            else:
                stream = self._store.create(self._path(name), False)
                stream.write(bytearray(data.encode()))
                stream.close()
        except (FileExistsError, Py4JJavaError) as e:
            if not self._store.exists(self._path(name)):
                raise
            raise BudgetError("another writer was first") from e
        return after + 1


def run_budget(ledger: BudgetLedger, command: str, texts: DataFrame, commit: Callable[[], tuple[str, str]] | None = None) -> dict:
    """`check` tells how many lines are left, or that the threshold is reached; `advance` sets the next checkpoint once the tree is at its target;
    `advance-if-pending` does so only where an override is set. `commit` gives the id and time of the tree's clean commit, or raises."""
    version, budget = ledger.read()
    if command == "advance-if-pending" and budget.override is None:
        return {"action": command, "pending": False, "message": "no checkpoint is pending"}
    if command not in ("check", "advance", "advance-if-pending"):
        raise BudgetError("use check, advance, or advance-if-pending")
    figures = {"threshold": budget.threshold, "refactor_target": budget.target, "required_reduction": budget.reduction}
    if command == "check":
        total = budget_lines(texts, budget)
        if total >= budget.threshold:
            raise BudgetError(f"{total:,} lines reach the checkpoint of {budget.threshold:,}; {budget.target:,} or fewer are to be left")
        return {"action": "check", "total": total, **figures, "message": f"{total}/{budget.threshold} lines ({budget.threshold - total} remaining)"}
    if commit is None:
        raise BudgetError("advance only from a clean commit")
    at, time = commit()
    total = budget_lines(texts, budget)
    if total > budget.target:
        raise BudgetError(f"the target is {budget.target} lines or fewer; there are {total}")
    ledger.write(version, replace(budget, checkpoints=(*budget.checkpoints, (budget.threshold, at, time)), override=None))
    return {"action": "advance", "total": total, **figures, "message": f"advanced past {budget.threshold} at {total} lines"}
