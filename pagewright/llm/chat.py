"""Chat formatting at the level of tokens.

Each segment of a turn is encoded by itself, so no token crosses the border of a segment, and reserved ids beyond the
tokenizer's vocabulary mark the borders and open each conversation: text can't make them. Control strings that occur in texts are escaped (one
more backslash before each), so that the printed form can be read back, too. The loss mask comes from prefix sums
over the ids: +1 behind the mark that opens an assistant's text, -1 at the mark that ends it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Marks of the template, as text; ids are given to them in this order behind the tokenizer's own.
MARKS = ["<|conversation|>", "<|system|>", "<|user|>", "<|assistant|>", "<|other|>", "<|text|>", "<|end|>"]
CONVERSATION, SYSTEM, USER, ASSISTANT, OTHER, TEXT, END = range(len(MARKS))
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Strings that trainers read as control: the template's and those of common chat formats.
CONTROL = [*MARKS, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>"]
ESCAPED = re.compile(r"(?<!\\)(\\*+)(" + "|".join(map(re.escape, CONTROL)) + ")")
#: White space as the encoder knows it, in runs so long that its search would run out of stack.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{256,}")
#: Ids in one row of an assembled conversation; a longer one has several rows, each of whole turns.
MOST_IDS = 1 << 18


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1][1:] + m[2], text)


def tokenizer(path: str):
    """The byte-level tokenizer of a .tiktoken file, kept in its worker process."""
    import public_tokenizers
    import tiktoken

    kept = sys.modules.setdefault("_kept_tokenizers", type(sys)("_kept_tokenizers"))
    if path not in vars(kept):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        vars(kept)[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return vars(kept)[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def first_mark(encoder) -> int:
    """The id of the first mark; the id before it stays free for the vocabulary's own end of text."""
    return encoder.max_token_value + 2


def encode(text: str, encoder) -> list[int]:
    """The tokenizer's ids of a text. A long run of white space is one piece up to its last character, which goes with
    what follows; it is handed over as a piece, as a search for it would overflow the encoder's stack."""
    out, at = [], 0
    for blank in LONG_BLANK.finditer(text):
        end = blank.end() - (blank.end() < len(text))
        out += encoder.encode_ordinary(text[at : blank.start()])
        out += encoder._encode_single_piece(text[blank.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:])


def turn_ids(role: str | None, text: str | None, encoder) -> list[int]:
    """Ids of one turn: its role's mark (for other roles their name behind a mark), the text, the end."""
    role, at = role or "", first_mark(encoder)
    head = [at + ROLES[role]] if role in ROLES else [at + OTHER, *encode(escape(role), encoder)]
    return [*head, at + TEXT, *encode(escape(text or ""), encoder), at + END]


def loss_mask(ids: np.ndarray, at: int) -> np.ndarray:
    """True for the ids of assistants' texts, without marks, by prefix sums over all ids. at: the id of the first mark."""
    step = np.zeros(len(ids) + 1, np.int8)
    text_marks = np.flatnonzero(ids == at + TEXT)
    opened = text_marks[ids[text_marks - 1] == at + ASSISTANT]
    ends = np.flatnonzero(ids == at + END)
    step[opened + 1] += 1
    step[ends[np.searchsorted(ends, opened)]] -= 1
    return np.cumsum(step[:-1]).astype(bool)


def _encoded(path: str):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = tokenizer(path)
        for roles, texts in columns:
            yield pa.array([turn_ids(r, t, encoder) for r, t in zip(roles.to_pylist(), texts.to_pylist())], pa.list_(pa.int32()))

    return run


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ids for every row of conversations (conv_id, turn, role, text needed), in partitions by
    conv_id and there in order of conv_id, turn, role, text (nulls first), so that repeated turns have an order, too.

    Null texts are empty; a null role is the empty name. Texts of any length get the ids that the tokenizer gives them
    whole. Encoding is done before the rows are dealt out, so one long conversation is encoded by many tasks. An empty
    table gives none; other columns are left out.
    """
    small_batches(conversations.sparkSession)
    ids = F.arrow_udf(_encoded(path or default_path()), "array<int>")(F.col("role"), F.col("text"))
    return (
        conversations.select("conv_id", "turn", "role", "text").withColumn("ids", ids).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def _assembled(path: str, most_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, kind = first_mark(tokenizer(path)), [], None
        now: list = []  # id of the conversation, part, ids of its turns, how many

        def close() -> None:
            ids = np.concatenate(now[2]).astype(np.int32)
            rows.append([now[0], now[1], ids, loss_mask(ids, at)])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids")):
                turn = ids.values.to_numpy()
                if now and now[0] == conv_id and now[3] + len(turn) > most_ids:
                    close()
                    now = [conv_id, now[1] + 1, [], 0]
                elif not now or now[0] != conv_id:
                    if now:
                        close()
                    now = [conv_id, 0, [np.full(1, at + CONVERSATION)], 1]
                now[2].append(turn)
                now[3] += len(turn)
            if sum(len(r[2]) for r in rows) > most_ids:
                yield _parts(rows, kind)
                rows.clear()
        if now:
            close()
            yield _parts(rows, kind)

    return run


def _parts(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "part", "ids", "mask"])


def assembled(formatted: DataFrame, path: str | None = None, most_ids: int = MOST_IDS) -> DataFrame:
    """conv_id, part, ids, mask for every conversation of format_turns(): its mark, then the ids of its turns in order, and
    the mask of what is learnt. A conversation of more than most_ids ids goes on in further parts, each of whole turns, so
    that no row grows with the conversation; the parts' ids, joined by part, are the conversation's."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "ids").mapInArrow(_assembled(path or default_path(), most_ids), f"conv_id {kind}, part int, ids array<int>, mask array<boolean>")


def printed(ids: list[int], encoder) -> str:
    """Marks as their strings, other ids decoded."""
    out, at, first = [], 0, first_mark(encoder)
    for i, x in enumerate([*ids, first]):
        if x >= first:
            out += [encoder.decode_bytes(ids[at:i]).decode(), MARKS[x - first]]
            at = i + 1
    return "".join(out[:-1])


def read_turn(ids: list[int], encoder) -> tuple[str, str]:
    """Role and text of one turn's ids."""
    first = first_mark(encoder)
    at = ids.index(first + TEXT)
    role = MARKS[ids[0] - first][2:-2] if ids[0] != first + OTHER else unescape(encoder.decode_bytes(ids[1:at]).decode())
    return role, unescape(encoder.decode_bytes(ids[at + 1 : -1]).decode())


READ = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, kind = tokenizer(path), None, None
        first, rows = first_mark(encoder), []

        def close() -> None:
            if now:
                rows.append([now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["printed"], now["tokens"], now["loss_tokens"]])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                ids, mask = ids.values.to_numpy(), np.array(mask.values)
                ends = np.flatnonzero(ids == first + END) + 1
                begin = int(ids[0] == first + CONVERSATION)
                if begin:
                    close()
                    now = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "printed": len(MARKS[CONVERSATION]), "tokens": 1, "loss_tokens": 0}
                for a, b in zip([begin, *ends[:-1].tolist()], ends.tolist()):
                    turn = ids[a:b].tolist()
                    role, text = read_turn(turn, encoder)
                    loss = unescape(encoder.decode_bytes(ids[a:b][mask[a:b]].tolist()).decode())
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["loss"].update(loss.encode())
                    now["chars"] += len(loss)
                    now["printed"] += len(printed(turn, encoder))
                    now["tokens"] += b - a
                    now["loss_tokens"] += int(mask[a:b].sum())
            if rows:
                yield _rows(rows, kind)
                rows.clear()
        close()
        if rows:
            yield _rows(rows, kind)

    return run


def _rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_back(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """A row per conversation of assembled(), told from its ids and mask alone: turns and digests, and what is under the
    mask. Rows come as assembled() leaves them, by conversation and part. Turns stream through running digests, so a
    conversation of any length takes the memory of one part."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "ids", "mask").mapInArrow(_read_back(path or default_path()), READ.format(kind))
