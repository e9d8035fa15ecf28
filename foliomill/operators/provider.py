"""Translation providers: the batch contract, a deterministic fake, response parsing, and the repair loop."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import fixed as X
from foliomill.functions import text as t

_WS, _KANA = re.compile(f"[{X.WS}]+"), re.compile(f"[{X.KANA}]")
MARK = "[tr]"
ITEMS = "array<struct<id:string,text:string>>"

#: A provider takes a batch (seg_id, text) and whether to be strict, and returns (seg_id, translation).
Provider = Callable[[pd.DataFrame, bool], pd.DataFrame]


def fake(items: DataFrame) -> DataFrame:
    """The fake provider as an expression: a mark and the text; texts with a failing flag get an error."""
    ok = ~F.col("fails")
    return items.select("seg_id", F.when(ok, F.concat(F.lit(MARK), "text")).alias("translation"), F.when(ok, F.lit(None)).otherwise(F.lit("simulated failure")).alias("error"))


def run_batches(items: DataFrame, provider: Provider, strict: bool = False) -> DataFrame:
    """Call a provider once a batch. items: (batch, seg_id, text)."""
    return items.groupBy("batch").applyInPandas(lambda p: provider(p[["seg_id", "text"]], strict)[["seg_id", "translation"]], "seg_id string, translation string")


def repair(items: DataFrame, provider: Provider, rounds: int = 3, min_chars: int = 20) -> DataFrame:
    """Up to some rounds over what is missing, empty or an echo. A batch goes through all its rounds at once, so items are
    dealt once and the provider is called only for what its batch lacks."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        todo, done = p[["seg_id", "text"]], []
        for k in range(rounds):
            if todo.empty:
                break
            text = dict(zip(todo["seg_id"], todo["text"], strict=True))
            got = provider(todo, k > 0)
            good = [(i, x) for i, x in zip(got["seg_id"], got["translation"], strict=True) if isinstance(i, str) and i in text and _usable(text[i], x, min_chars)]
            have = {i for i, _ in good}
            done += good
            todo = todo[[i not in have for i in todo["seg_id"]]].reset_index(drop=True)
        rows = [(i, x, None) for i, x in done] + [(i, None, "no usable answer") for i in todo["seg_id"]]
        return pd.DataFrame(rows, columns=["seg_id", "translation", "error"])

    return items.groupBy("batch").applyInPandas(run, "seg_id string, translation string, error string")


def _usable(source: str | None, target: str | None, min_chars: int) -> bool:
    """The rule of text.is_untranslated, and that the target is not empty, for one pair."""
    if not isinstance(target, str) or not target.strip(" "):
        return False
    s = _WS.sub("", source) if isinstance(source, str) else ""
    return not (s and len(s) >= min_chars and s == _WS.sub("", target) and _KANA.search(s))


def parse_response(content: Column) -> Column:
    """array<struct<id, text>> of {"translations": [...]} or a bare array, fences removed; null where it is neither.

    Items without an id are skipped. from_json gives a struct of nulls for bad input, so a parse decides first.
    """
    bare = t.strip_fences(content)
    wrapped = F.get_json_object(bare, "$.translations")
    body = F.coalesce(wrapped, bare)
    items = F.from_json(body, ITEMS)
    ok = F.try_parse_json(body).isNotNull() & F.startswith(F.ltrim(body), F.lit("["))
    return F.when(ok, F.filter(items, lambda i: i["id"].isNotNull()))


def answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests: (batch, seg_id); responses: (batch, content). Each id with its last text, or an error."""
    parsed = responses.select("batch", F.posexplode(parse_response(F.col("content"))).alias("pos", "i"))
    last = parsed.groupBy("batch", F.col("i.id").alias("seg_id")).agg(F.max_by(F.col("i.text"), "pos").alias("translation"))
    j = requests.join(last, ["batch", "seg_id"], "left")
    return j.withColumn("error", F.when(F.trim(t.text_of("translation")) == "", "missing"))


def payload(items: DataFrame) -> DataFrame:
    """batch, payload: the JSON of a batch in order."""
    xs = F.array_sort(F.collect_list(F.struct("ord", F.col("seg_id").alias("id"), "text")))
    return items.groupBy("batch").agg(F.to_json(F.transform(xs, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))).alias("payload"))


def usage(results: DataFrame) -> DataFrame:
    """batch, calls, tokens; an endpoint that reports none is charged by length."""
    n_in = F.when(F.col("tokens_in") == 0, F.floor(F.length("prompt") / 2)).otherwise(F.col("tokens_in"))
    n_out = F.when(F.col("tokens_out") == 0, F.floor(F.length("answer") / 2)).otherwise(F.col("tokens_out"))
    return results.groupBy("batch").agg(F.count(F.lit(1)).alias("calls"), F.sum(n_in).alias("tokens_in"), F.sum(n_out).alias("tokens_out"))


def summary_prompt(title: Column, text: Column, budget: Column) -> Column:
    return F.concat(F.lit("Summarise the chapter "), title, F.lit(" in at most "), budget.cast("string"), F.lit(" characters:\n"), text)


def accept_compression(summary: Column, shorter: Column, budget: Column) -> Column:
    """The compressed summary where the first was over 1.5 budgets and the second is shorter."""
    return F.when((F.length(summary) > budget * 1.5) & (F.length(shorter) < F.length(summary)), shorter).otherwise(summary)
