"""Payloads of extractors: lenient JSON, routing of models and request limits."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_DECODER, _BLANK = json.JSONDecoder(), re.compile(r"[\s,:]*")


def _read(text: str, at: int) -> tuple[object, int | None]:
    """The value at a place and where it ends, None if the text ends first: then what there is of it."""
    try:
        return _DECODER.raw_decode(text, at)
    except ValueError:
        pass
    of_pairs = text.startswith("{", at)
    if not of_pairs and not text.startswith("[", at):
        raise ValueError("neither a value nor the start of one")
    out: list = []
    at += 1
    try:
        while True:
            at = _BLANK.match(text, at).end()
            name = None
            if of_pairs:
                name, at = _DECODER.raw_decode(text, at)
                at = _BLANK.match(text, at).end()
            value, end = _read(text, at)
            out.append((name, value, end is not None))
            if end is None:
                break
            at = end
    except (ValueError, RecursionError):
        pass
    return _Cut(of_pairs, out), None


class _Cut:
    """What there is of an object or array that is cut off: (name, value, whether it is whole)."""

    def __init__(self, of_pairs: bool, parts: list):
        self.of_pairs, self.parts = of_pairs, parts


def _parts(value) -> tuple[bool, list]:
    if isinstance(value, _Cut):
        return value.of_pairs, value.parts
    if isinstance(value, dict):
        return True, [(k, v, True) for k, v in value.items()]
    return False, [(None, v, True) for v in value] if isinstance(value, list) else []


def _up_to_last_element(value):
    """The value up to its last whole object or array that is an element of an array; None without one."""
    of_pairs, parts = _parts(value)
    for k in range(len(parts) - 1, -1, -1):
        name, part, whole = parts[k]
        element = not of_pairs and whole and isinstance(part, (dict, list))
        kept = part if element else _up_to_last_element(part)
        if element or kept is not None:
            before = parts[:k]
            return {n: v for n, v, _ in before} | {name: kept} if of_pairs else [*[v for _, v, _ in before], kept]
    return None


def salvage(text: str | None) -> str | None:
    """The JSON of an answer, whole or, if it is cut off, up to its last whole array element."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    at = body.find("{")
    if at < 0:
        return None
    value, end = _read(body, at)
    if end is None:
        value = _up_to_last_element(value)
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def salvaged(text: Column) -> Column:
    """salvage() over Arrow batches."""
    return F.pandas_udf(lambda s: s.map(salvage), "string", F.PandasUDFType.SCALAR)(text)


def parsed(text: Column) -> Column:
    """JSON as it stands, else from its first brace; null if neither parses. Stays in the JVM."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def eligible_models(models: DataFrame, tier: int, tokens: int) -> DataFrame:
    """Models that a request fits, best first: least waiting and penalty, then most free tokens.

    models: model_id, tier, context_limit, tpm, used_tpm, wait_s, penalty_s, left_today."""
    free = F.col("tpm") - F.col("used_tpm")
    ok = models.where((F.col("tier") >= tier) & (F.col("context_limit") >= tokens) & (F.col("tpm") >= tokens) & (F.coalesce("left_today", F.lit(1)) > 0))
    return ok.withColumn("rank", F.row_number().over(Window.orderBy(F.col("wait_s") + F.col("penalty_s"), free.desc(), "model_id")))


def token_bucket(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """Waiting time of each request of a key under a continuously refilled bucket, in order of time.

    requests: key, seq, at_s, cost. The level after each request depends on all before it."""
    kind = dict(requests.dtypes)["key"]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        level, last, waits = capacity, None, []
        pdf = pdf.sort_values("seq")
        for at, cost in zip(pdf["at_s"], pdf["cost"]):
            if last is not None and at > last:
                level = min(capacity, level + (at - last) * rate)
            last = at if last is None else max(last, at)
            short = max(0.0, cost - level)
            waits.append(round(short / rate, 6))
            level = level - cost
        return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "wait_s": waits})

    return requests.groupBy("key").applyInPandas(step, f"key {kind}, seq long, wait_s double")
