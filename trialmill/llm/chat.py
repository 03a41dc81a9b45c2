"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered by a template, encoded once with character offsets, and the sorted spans of the
assistant's texts are intersected with the token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters that control strings need, and what stands for them inside roles and texts.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
#: The role whose texts are under the loss mask.
LEARNED = "assistant"

_TURN = re.compile(f"{OPEN}([^#<:]*){MIDDLE}([^#<]*){CLOSE}")
_BACK = {v: k for k, v in ESCAPES.items()}
_TO = str.maketrans(ESCAPES)
_TO_TEXT = str.maketrans({k: v for k, v in ESCAPES.items() if k != ":"})


def escape(text: str, role: bool = False) -> str:
    return text.translate(_TO if role else _TO_TEXT)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns -> the formatted conversation and the spans of its texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, True) + MIDDLE, escape(text)
        parts += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """render() backwards."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def overlap(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sorted token spans and sorted text spans -> mask of the tokens that reach into a span, and the covered parts of each span."""
    mask, covered = np.zeros(len(starts), dtype=bool), []
    begin, end = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True)) if spans else (np.empty(0, dtype=np.int64),) * 2
    first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left")
    for a, z, x, y in zip(begin.tolist(), end.tolist(), first.tolist(), last.tolist(), strict=True):
        if x >= y or a >= z:
            continue
        mask[x:y] |= ends[x:y] > starts[x:y]
        # Tokens of one character's bytes share its span; a part begins where a token leaves a gap behind all before it.
        low, high = np.maximum(starts[x:y], a), np.maximum.accumulate(np.minimum(ends[x:y], z))
        cut = np.flatnonzero(low[1:] > high[:-1]) + 1
        parts = zip(low[np.concatenate(([0], cut))].tolist(), high[np.concatenate((cut - 1, [y - x - 1]))].tolist(), strict=True)
        covered += [(p, q) for p, q in parts if q > p]
    return mask, covered


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, loss_spans array<array<int>>"


def format_chats(conversations: DataFrame, path: str | None = None, learned: str = LEARNED, tokens: bool = True) -> DataFrame:
    """One row for each conversation: its formatted text, tokens with offsets, loss mask and the spans of text under it.

    tokens=False leaves out the columns of single tokens, for whoever only wants the spans that they cover.

    Turns go by turn, ties by role and text; repeated turns stay. Null texts and roles are empty; null turn numbers come
    first; rows with null conv_id form a conversation of their own. Empty texts have no loss. An empty table gives an
    empty result; other columns are ignored. One conversation becomes one row, so it has to fit a task; no more than
    one is held at a time.
    """
    path = path or default_tokenizer()
    columns = [c for c in SCHEMA.split(", ") if tokens or not c.startswith(("token_", "loss_mask"))]

    def one(conv, turns: list[tuple[str, str]]) -> tuple:
        text, spans = render(turns)
        enc = tokenizer(path).encode(text, add_special_tokens=False)
        offsets = np.asarray(enc.offsets, dtype=np.int64).reshape(-1, 2)
        mask, covered = overlap(offsets[:, 0], offsets[:, 1], [s for s, (role, _) in zip(spans, turns, strict=True) if role == learned])
        single = (np.array(enc.ids, dtype=np.int32), offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32), mask) if tokens else ()
        return (conv, len(turns), text, *single, [list(c) for c in covered])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in columns]
        open_, turns, rows, size = None, [], [], 0
        for b in batches:
            for conv, lone, role, text in zip(b["conv_id"], b["lone"], b["role"], b["text"], strict=True):
                key = None if lone else int(conv)
                if turns and key != open_:
                    rows.append(one(open_, turns))
                    size += len(rows[-1][2])
                    turns = []
                    if size > 1 << 21:
                        yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
                        rows, size = [], 0
                open_ = key
                turns.append((role, text))
        if turns:
            rows.append(one(open_, turns))
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    empty = F.lit("")
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("lone"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = turns.repartition("conv_id", "lone").sortWithinPartitions("conv_id", "lone", "turn", "role", "text")
    return dealt.select("conv_id", "lone", "role", "text").mapInPandas(each, ", ".join(columns))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and loss spans."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"], strict=True):
                turns = parse(text)
                # An escape never straddles two spans in a way that matters: the parts are joined before they are read.
                loss = unescape("".join(text[a:z] for a, z in spans))
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return digests(format_chats(given.unionByName(extra), tokens=False))


QUERIES = {"op10_chat_format": op10_chat_format}
ORACLE = {
    "op10_chat_format": r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + 2 + 8 + length(role) + length(text)
         + length(role) - length(translate(role, '\#<:', '')) + length(text) - length(translate(text, '\#<', '')) AS chars
  FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
