"""Targets from transcripts: a rule extractor, response parsing, match counts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Verbs that state a goal (strict mode).
GOAL_VERBS = ["achieve", "target", "maintain", "expect", "deliver", "reach", "sustain", "exceed", "grow", "generate", "drive", "hit", "attain", "improve", "increase"]
MONEY = r"[$€£¥]\s?\d+(?:[.,]\d+)*(?:\s?(?:million|billion|trillion|thousand|mn|bn|tn))?"
PERCENT = r"\d+(?:[.,]\d+)*\s?(?:%|percent)"
SUBJECT = r"(?i)\b((?:[a-z&-]+\s+){0,3}[a-z&-]+)\s+(?:was|were|is|are|be|reached|totaled|remained|hit|came)\s+(?:in\s+at\s+)?"


def rule_targets(components: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each money or percent phrase of each sentence, with its subject, all by built-in expressions.

    Null and blank texts give no rows; phrases are unique in their sentence.
    """
    s = components.withColumn("sentence", F.explode(T.sentences(F.coalesce("text", F.lit("")))))
    found = F.concat(
        F.transform(F.regexp_extract_all("sentence", F.lit(f"({MONEY})"), 1), lambda x: F.struct(F.lit("MONEY").alias("entity_label"), x.alias("value_text"))),
        F.transform(F.regexp_extract_all("sentence", F.lit(f"({PERCENT})"), 1), lambda x: F.struct(F.lit("PERCENT").alias("entity_label"), x.alias("value_text"))),
    )
    out = s.withColumn("m", F.explode(F.array_distinct(found))).select("*", "m.*").drop("m")
    subject = F.regexp_extract("sentence", SUBJECT, 1)
    verb = F.regexp_extract(F.lower("sentence"), r"\b(" + "|".join(GOAL_VERBS) + r")(?:s|d|ed|ing)?\b", 1)
    out = out.withColumns({"target_text": F.when(subject == "", F.col("value_text")).otherwise(subject), "governing_verb": verb, "is_financial": F.lit(True)})
    out = out.withColumn("normalized_text", T.normalised_target(F.col("target_text")))
    return out.where("governing_verb <> ''") if strict else out


# Fences of code around a reply, what it is searched for when it is no JSON as a whole, and the fields by which an object is a target.
FENCE, FENCE_END = r"^```(?:json)?\s*", r"\s*```$"
FIRST_LIST, FLAT_OBJECT = r"(?s)\[.*?\]", r"\{[^{}]*\}"
TARGET_FIELDS = ["metric_name", "raw_text", "numerical_value", "trend_direction", "unit", "time_horizon", "confidence"]


def _kind(v: Column, *names: str) -> Column:
    kind = F.schema_of_variant(v)
    return reduce(lambda a, b: a | b, [kind.startswith(n) for n in names])


def _parsed(text: Column) -> Column:
    v = F.try_parse_json(text)
    return F.when(~F.is_variant_null(v), v)


def _objects(values: Column) -> Column:
    return F.filter(values, lambda x: _kind(x, "OBJECT"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _target_like(values: Column) -> Column:
    wanted = F.array(*map(F.lit, TARGET_FIELDS))
    return F.filter(values, lambda x: F.coalesce(F.arrays_overlap(F.map_keys(_fields(x)), wanted), F.lit(False)))


def reply_objects(raw: Column) -> Column:
    """The objects of a model's reply that tell targets, as an array of variants: empty for an empty reply, null where there is nothing to read.

    The reply, without fences, is read as JSON; failing that its first list;
    failing that its flat objects that look like targets. Of an object, the list
    ``targets`` counts, else the first list that holds objects, else the object
    itself if it looks like a target. An object with a key twice is no JSON.
    """
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, FENCE, ""), FENCE_END, ""), r"^\s+|\s+$", "")
    body = F.when(trimmed.startswith("```"), bare).otherwise(trimmed)
    value = F.coalesce(_parsed(body), _parsed(F.nullif(F.regexp_extract(body, FIRST_LIST, 0), F.lit(""))))
    flat = _objects(F.filter(F.transform(F.regexp_extract_all(body, F.lit(FLAT_OBJECT), F.lit(0)), _parsed), lambda x: x.isNotNull()))
    a_list = lambda v: F.when(_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    own = F.try_variant_get(value, "$.targets", "variant")
    # the reply's own order of keys, as a variant sorts them
    lists = F.transform(F.json_object_keys(body), lambda k: _objects(a_list(F.try_element_at(_fields(value), k))))
    first = F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0))
    alone = F.filter(_target_like(F.array(value)), lambda x: x.isNotNull())
    of_object = F.coalesce(_objects(a_list(own)), first, F.when(F.size(alone) > 0, alone))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<variant>"))
        .when(value.isNull(), F.when(F.size(flat) > 0, _target_like(flat)))
        .when(_kind(value, "ARRAY"), _objects(a_list(value)))
        .when(_kind(value, "OBJECT"), of_object)
    )


def reply_targets(raw: Column) -> Column:
    """:func:`reply_objects` as structs of TARGET_FIELDS; texts as they are, a number only where the reply has a number."""
    number = lambda x: F.try_variant_get(x, "$.numerical_value", "variant")
    told = lambda x: F.when(_kind(number(x), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(x, "$.numerical_value", "double"))
    return F.transform(reply_objects(raw), lambda x: F.struct(*[(told(x) if f == "numerical_value" else F.try_variant_get(x, f"$.{f}", "string")).alias(f) for f in TARGET_FIELDS]))


COUNTERS = ("requests", "retries", "failures", "tokens_in", "tokens_out", "empty", "replies", "waited")


class LimitedClient:
    """A client held to requests and tokens a minute, retried with growing pauses; it counts what it does.

    Threads can share it. Each partition has a copy of its own, whose limits
    :func:`called` divides by the tasks that run at once; ``counters`` are of one
    copy, :class:`Totals` brings them together.
    """

    def __init__(self, client: Callable[[str], str], requests: float = 600, tokens: float = 2_000_000, retries: int = 6, base: float = 1.0, cap: float = 60.0, sleep=time.sleep, clock=time.monotonic):
        self.client, self.retries, self.base, self.cap, self.sleep, self.clock = client, retries, base, cap, sleep, clock
        self.rates, self.left, self.at = (requests / 60, tokens / 60), [requests, tokens], None
        self.most = (requests, tokens)
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.counters["waited"] = 0.0
        self.lock = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lock": None}

    def divided(self, tasks: int) -> LimitedClient:
        """A copy with its share of the limits, one request and token a minute at least, and with counters at 0."""
        requests, tokens = (max(1.0, m / max(1, tasks)) for m in self.most)
        return LimitedClient(self.client, requests, tokens, self.retries, self.base, self.cap, self.sleep, self.clock)

    def _held(self) -> threading.Lock:
        if self.lock is None:
            self.lock = threading.Lock()
        return self.lock

    def _count(self, **more: float) -> None:
        with self._held():
            for k, n in more.items():
                self.counters[k] += n

    def _take(self, tokens: int) -> None:
        """Wait until a request of so many tokens fits; one of more than a minute's tokens waits for a full minute's."""
        wants = (1, min(tokens, self.most[1]))
        while True:
            with self._held():
                now = self.clock()
                past = 0.0 if self.at is None else now - self.at
                self.at = now
                self.left = [min(m, x + past * r) for m, x, r in zip(self.most, self.left, self.rates)]
                pause = max((w - x) / r for w, x, r in zip(wants, self.left, self.rates))
                if pause <= 0:
                    self.left = [x - w for x, w in zip(self.left, wants)]
                    return
                self.counters["waited"] += pause
            self.sleep(pause)

    def __call__(self, text: str) -> str:
        n = max(1, len(text) // 4) if text else 0
        for k in range(self.retries + 1):
            self._take(n)
            self._count(requests=1)
            try:
                reply = self.client(text)
            except Exception:
                if k == self.retries:
                    self._count(failures=1)
                    raise
                self._count(retries=1)
                self.sleep(min(self.base * 2**k, self.cap))
                continue
            self._count(tokens_in=n, tokens_out=len(reply or "") // 4, **{"replies" if reply else "empty": 1})
            return reply
        raise AssertionError


class Totals:
    """Counters of all partitions' clients on the driver, after an action; a task that is run again has called again, and counts again."""

    def __init__(self, spark: SparkSession):
        self.sums = {k: spark.sparkContext.accumulator(0.0) for k in COUNTERS}

    def add(self, counters: dict[str, float]) -> None:
        for k, n in counters.items():
            self.sums[k].add(float(n))

    def values(self) -> dict[str, float]:
        return {k: a.value for k, a in self.sums.items()}


def called(chunks: DataFrame, client: Callable[[str], str], keys: list[str], text: str = "chunk", at_once: int = 8, totals: Totals | None = None) -> DataFrame:
    """The keys with a client's ``reply`` to each chunk, or the ``error`` of a call that failed.

    A partition has ``at_once`` calls under way at most, whose replies come out
    in the order of the chunks. The limits of a :class:`LimitedClient` hold for
    all tasks that can run at once.
    """
    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", reply string, error string"
    tasks = chunks.sparkSession.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client.divided(tasks) if isinstance(client, LimitedClient) else client

        def one(chunk: str) -> tuple[str | None, str | None]:
            try:
                return own(chunk), None
            except Exception as e:  # noqa: BLE001  a failed call is a row, not a failed job
                return None, str(e)[:200]

        try:
            with ThreadPoolExecutor(at_once) as pool:
                for f in frames:
                    for lo in range(0, len(f), 16 * at_once):  # so many calls are planned ahead
                        part = f.iloc[lo : lo + 16 * at_once]
                        told = list(pool.map(one, part[text].tolist()))
                        yield pd.DataFrame({**{k: part[k].tolist() for k in keys}, "reply": [r for r, _ in told], "error": [e for _, e in told]}, columns=[*keys, "reply", "error"])
        finally:
            if totals is not None and isinstance(own, LimitedClient):
                totals.add(own.counters)

    return chunks.mapInPandas(run, schema)


def extract_with(chunks: DataFrame, client: Callable[[str], str], keys: list[str], text: str = "chunk", at_once: int = 8, totals: Totals | None = None) -> DataFrame:
    """Run a client over chunks, a partition at a time, and explode what its replies hold, which built-in expressions read; a client that fails leaves an error."""
    found = called(chunks, client, keys, text, at_once, totals).withColumn("t", F.when(F.col("error").isNull(), reply_targets(F.col("reply"))))
    rows = found.select(*keys, F.explode_outer("t").alias("t"), "error").where("t is not null or error is not null")
    return rows.select(*keys, "t.metric_name", "t.numerical_value", "t.confidence", "t.raw_text", "error")


def extracted(transcripts: DataFrame, components: DataFrame, client: Callable[[str], str] | None, known: DataFrame | None = None, budget: int = 12_000, totals: Totals | None = None) -> DataFrame:
    """transcript_id, targets (an array of structs of TARGET_FIELDS) and errors (an array) of each transcript.

    Targets that are ``known`` (transcript_id, pos and TARGET_FIELDS) spare the
    client; else the components that are not blank are joined by type and
    packed into chunks; else the transcript's own ``text`` is, which leaves a
    warning. A transcript without either, or without a client, has no targets
    and an error; a call that fails leaves its error and the other chunks'
    targets. Targets are in the order of type, chunk and reply. Of a transcript
    that repeats one row comes out.
    """
    fields = F.struct(*TARGET_FIELDS)
    kind = "array<struct<" + ", ".join(f"{f}:{'double' if f == 'numerical_value' else 'string'}" for f in TARGET_FIELDS) + ">>"
    calls = transcripts.groupBy("transcript_id").agg(F.max("text").alias("text"))
    blank = lambda c: F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))) == 0
    done = None
    if known is not None:
        done = known.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", fields.alias("t")))), lambda x: x["t"]).cast(kind).alias("targets"))
        done = calls.select("transcript_id").join(done, "transcript_id").withColumn("errors", F.array().cast("array<string>"))
        calls = calls.join(known.select("transcript_id").distinct(), "transcript_id", "left_anti")
    parts = components.where(~blank(F.col("text"))).join(calls.select("transcript_id"), "transcript_id", "left_semi")
    flat = calls.join(parts.select("transcript_id").distinct(), "transcript_id", "left_anti")
    bare = flat.where(blank(F.col("text"))).select("transcript_id", F.lit("no text and no components").alias("error"))
    flat = flat.where(~blank(F.col("text")))
    warned = flat.select("transcript_id", F.lit("no components: the text is read as one").alias("error"))
    chunks = chunked(parts.select("transcript_id", "ctype", "ord", "text").unionByName(flat.select("transcript_id", F.lit(0).alias("ctype"), F.lit(0).cast(dict(parts.dtypes)["ord"]).alias("ord"), "text")), budget=budget)
    problems = bare.unionByName(warned)
    if client is None:
        problems = problems.unionByName(calls.select("transcript_id").join(bare, "transcript_id", "left_anti").select("transcript_id", F.lit("no client").alias("error")))
        told = calls.select("transcript_id").where("false").withColumn("targets", F.array().cast(kind))
    else:
        # the replies are needed twice, and a call should be made once: what is found and what failed go on in one row a chunk
        replies = called(chunks, client, ["transcript_id", "ctype", "chunk_no"], totals=totals)
        row = F.struct("ctype", "chunk_no", F.coalesce(reply_targets(F.col("reply")), F.array()).cast(kind).alias("t"), "error")
        told = replies.groupBy("transcript_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
        told = told.select("transcript_id", F.flatten(F.transform("r", lambda x: x["t"])).alias("targets"), F.filter(F.transform("r", lambda x: x["error"]), lambda e: e.isNotNull()).alias("failed"))
    if client is None:
        told = told.withColumn("failed", F.array().cast("array<string>"))
    wrong = problems.groupBy("transcript_id").agg(F.array_sort(F.collect_list("error")).alias("e"))
    out = calls.select("transcript_id").join(told, "transcript_id", "left").join(wrong, "transcript_id", "left")
    none = F.array().cast("array<string>")
    out = out.select("transcript_id", F.coalesce("targets", F.array().cast(kind)).alias("targets"), F.concat(F.coalesce("e", none), F.coalesce("failed", none)).alias("errors"))
    return out if done is None else out.unionByName(done)


def chunked(components: DataFrame, keys: tuple[str, ...] = ("transcript_id", "ctype"), order: str = "ord", budget: int = 12_000) -> DataFrame:
    """Components of a type joined in order and packed into chunks."""
    g = components.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    return g.select(*keys, F.posexplode(T.packed_chunks(T.sentences(whole), budget)).alias("chunk_no", "chunk"))


def exact_matches(pred: DataFrame, truth: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Predictions whose name is among the truths of their keys, by keys."""
    return pred.join(truth.select(*keys, name).distinct(), [*keys, name], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))


def greedy_matches(pred: Column, truth: Column, least: float = 0.7) -> Column:
    """How many predictions, in order, take the best truth that is still free and at least ``least`` alike (the first of equals)."""

    def step(acc: Column, p: Column) -> Column:
        scored = F.transform(truth, lambda g, i: F.struct(jaccard(p, g).alias("s"), (-i).alias("i")))
        free = F.filter(scored, lambda x: (x["s"] >= least) & ~F.array_contains(acc, -x["i"]))
        return F.when(F.size(free) > 0, F.array_append(acc, -F.array_max(free)["i"])).otherwise(acc)

    return F.size(F.aggregate(pred, F.array().cast("array<int>"), step))


def f1(matched: Column, n_pred: Column, n_true: Column) -> Column:
    """precision, recall and f1, 0 where undefined."""
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = d(matched, n_pred), d(matched, n_true)
    return F.struct(p.alias("precision"), r.alias("recall"), d(2 * p * r, p + r).alias("f1"))
