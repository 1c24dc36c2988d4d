"""The command line: queries, stages and their state."""

from __future__ import annotations

import argparse
import hashlib
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import session
from .operators import moving_targets as M
from .operators import report as R
from .operators import vectors as V
from .plans import catalog
from .sources import io
from .sources import standins as X


def _targets(spark: SparkSession, data: str, out: str) -> DataFrame:
    return M.target_sets(X.targets(spark, data))


def _baseline(spark: SparkSession, data: str, out: str) -> DataFrame:
    sets = spark.read.parquet(f"{out}/targets")
    return M.exact_mt(sets, sets.select("company", "q_int"))


def _matching(spark: SparkSession, data: str, out: str) -> DataFrame:
    v = X.vectors(spark, data)
    return V.semantic_mt(v, v.select("company", "q_int"), 0.30, 0.15)


def _reports(spark: SparkSession, data: str, out: str) -> DataFrame:
    """Reports on vectors that stand for the targets of their company, which they are dealt in order of names."""
    sets = spark.read.parquet(f"{out}/targets").withColumn("company", F.col("company").cast("int"))
    v = X.vectors(spark, data)
    names = sets.groupBy("company", "norm").agg(F.max("is_financial").alias("is_financial"))
    dealt = names.withColumns({"k": F.row_number().over(Window.partitionBy("company").orderBy("norm")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("company"))})
    own = v.select("company", "idx").join(dealt.select("company", "n").distinct(), "company").withColumn("k", (F.col("idx") % F.col("n")).cast("int"))
    named = own.join(dealt.drop("n"), ["company", "k"]).select("company", "idx", "norm", "is_financial")
    return R.run_reports(v, named, sets, 0.30, 0.15)


def _evaluation(spark: SparkSession, data: str, out: str) -> DataFrame:
    return catalog.queries()["fama_macbeth"](spark, data)


#: Stages in order; each writes a folder of its name.
STAGES: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {"targets": _targets, "baseline": _baseline, "matching": _matching, "reports": _reports, "evaluation": _evaluation}


#: What each stage reads: tables of the data folder, and stages.
READS: dict[str, tuple[list[str], list[str]]] = {
    "targets": (["part", "supplier", "lineitem"], []),
    "baseline": ([], ["targets"]),
    "matching": (["embeddings"], []),
    "reports": (["embeddings"], ["targets"]),
    "evaluation": (["lineitem"], []),
}


def chosen(start: str | None, stop: str | None, skip: list[str]) -> list[str]:
    names = list(STAGES)
    for n in [start, stop, *skip]:
        if n is not None and n not in names:
            raise ValueError(f"no stage {n}; there are {', '.join(names)}")
    lo, hi = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
    return [n for n in names[lo : hi + 1] if n not in skip]


def _code() -> str:
    """A digest of the package's code but for the training-data operators, which no stage uses."""
    here = Path(__file__).resolve().parent
    files = sorted(f for f in here.rglob("*.py") if "llm" not in f.relative_to(here).parts)
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def fingerprint(spark: SparkSession, name: str, data: str, out: str) -> dict:
    """What a stage's output depends on: its input files by length and time, its own and the package's code, and the runs of the stages that it reads."""
    tables, stages = READS[name]
    fn = STAGES[name].__code__
    own = hashlib.sha256(repr((fn.co_code, fn.co_names, [c for c in fn.co_consts if not hasattr(c, "co_code")])).encode()).hexdigest()
    return {"data": data, "inputs": {t: io.files(spark, f"{data}/{t}.parquet") for t in tables}, "code": [_code(), own], "after": {s: (_state(spark, out, s) or {}).get("run") for s in stages}}


def _state(spark: SparkSession, out: str, name: str) -> dict | None:
    """The fingerprint under which a finished output was written, with the ``run`` that wrote it."""
    return io.read_json_artefact(spark, f"{out}/_state/{name}") if io.exists(spark, f"{out}/{name}/_SUCCESS") else None


def is_current(spark: SparkSession, name: str, data: str, out: str) -> bool:
    """Whether a finished output was written under the present fingerprint."""
    state = _state(spark, out, name)
    return state is not None and {k: v for k, v in state.items() if k != "run"} == fingerprint(spark, name, data, out)


def run_stages(spark: SparkSession, data: str, out: str, names: list[str], go_on: bool = False, dry: bool = False, force: bool = False) -> dict[str, str]:
    """What became of each stage: done, current (left as it is, unless ``force``), failed or planned; after a failure the others are left unless ``go_on``.

    The state is removed before a stage is written and written after it, so a
    stage that a crash cut off is not current.
    """
    state = {}
    for n in names:
        if dry:
            state[n] = "planned"
            continue
        try:
            if not force and is_current(spark, n, data, out):
                state[n] = "current"
                continue
            print_ = fingerprint(spark, n, data, out)
            io.removed(spark, f"{out}/_state/{n}")
            io.write_parquet(STAGES[n](spark, data, out), f"{out}/{n}")
            io.write_json_artefact(spark, print_ | {"run": uuid.uuid4().hex}, f"{out}/_state/{n}")
            state[n] = "done"
        except Exception as e:  # noqa: BLE001  the state of a stage is what is asked for
            state[n] = f"failed: {str(e).splitlines()[0][:200]}"
            if not go_on:
                break
    return state


def status(spark: SparkSession, out: str) -> tuple[dict[str, str], str | None]:
    """ready, stale, partial or missing for each stage, and the next one to run.

    A stage is stale if it, its inputs or a stage that it reads have changed since it was written.
    """
    found: dict[str, str] = {}
    for n in STAGES:
        if not io.exists(spark, f"{out}/{n}/_SUCCESS"):
            found[n] = "partial" if io.exists(spark, f"{out}/{n}") else "missing"
            continue
        state = _state(spark, out, n)
        fresh = state is not None and is_current(spark, n, state["data"], out) and all(found[s] == "ready" for s in READS[n][1])
        found[n] = "ready" if fresh else "stale"
    return found, next((n for n, s in found.items() if s != "ready"), None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftlens")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--out")
    r = sub.add_parser("run")
    for a in ("--data", "--out"):
        r.add_argument(a, required=True)
    for a in ("--start", "--stop"):
        r.add_argument(a)
    r.add_argument("--skip", action="append", default=[])
    r.add_argument("--continue-on-error", action="store_true")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--force", action="store_true")
    s = sub.add_parser("status")
    s.add_argument("--out", required=True)
    t = sub.add_parser("thresholds")
    t.add_argument("--file")
    for a in ("--maintained", "--rephrased"):
        t.add_argument(a, type=float)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or session.session()
    if args.command == "query":
        if args.name not in catalog.queries():
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        df = catalog.queries()[args.name](spark, args.data)
        if args.out:
            io.write_parquet(df, args.out)
        else:
            df.show(20, truncate=False)
        return 0
    if args.command == "run":
        state = run_stages(spark, args.data, args.out, chosen(args.start, args.stop, args.skip), args.continue_on_error, args.dry_run, args.force)
        print("\n".join(f"{n}\t{s}" for n, s in state.items()))
        return 1 if any(s.startswith("failed") for s in state.values()) else 0
    if args.command == "status":
        found, following = status(spark, args.out)
        print("\n".join(f"{n}\t{s}" for n, s in found.items()))
        print(f"next\t{following or 'none'}")
        return 0
    from .operators.calibration import resolve_thresholds

    stored = io.read_json_artefact(spark, args.file) if args.file else None
    m, r, used = resolve_thresholds(stored, args.maintained, args.rephrased)
    print(f"maintained\t{m}\nrephrased\t{r}\nstored\t{used}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
