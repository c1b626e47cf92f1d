"""Chat formatting at token level.

Every role and text is encoded by itself, reserved ids are spliced between the
segments, and the loss mask follows from prefix sums of segment lengths.  Control
strings inside content are escaped before encoding, so that neither the ids nor
the formatted string can be mistaken for markup, and can be restored exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: <s> opens a conversation, each turn is [INST]role[/INST]text</s>.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: The reserved ids lie just above the tokenizer's own.
FIRST_RESERVED = 50_257
BOS, EOS, OPEN, CLOSE = range(FIRST_RESERVED, FIRST_RESERVED + 4)

_ESCAPE = re.compile(r"([<\[])(?=\\*/?(?:s>|INST\]))")
_UNESCAPE = re.compile(r"([<\[])\\(?=\\*/?(?:s>|INST\]))")


def escape(text: str) -> str:
    """A backslash goes into each control string, and one more into each that already has some."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


#: Fixed value: how the byte-level vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _tokenizer(path: str) -> tiktoken.Encoding:
    """Without special tokens, so that no text is ever read as one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of segments (ids, under the loss): +1 where such a segment starts, -1 where it ends, summed."""
    ends = np.cumsum([len(s) for s, _ in segments])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for end, (ids, loss) in zip(ends, segments, strict=True):
        if loss and ids:
            steps[end - len(ids)] += 1
            steps[end] -= 1
    return np.array([i for s, _ in segments for i in s], np.int32), np.cumsum(steps[:-1]).astype(bool)


def _parts(batches: Iterator[pa.RecordBatch], most_turns: int, most_ids: int) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, n_turns, ids, loss_mask) of encoded turns (conv_id, ids, mask) that come in order; one part is held at a time."""
    now, part, n_turns, n_ids = object(), 0, 0, 0
    chunks: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[tuple] = []
    size = 0

    def told() -> pa.RecordBatch:
        conv, number, turns, ids, mask = zip(*done, strict=True)
        ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, mask)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array(turns, pa.int64()), *lists], ["conv_id", "part", "n_turns", "ids", "loss_mask"])

    def close() -> None:
        nonlocal size
        if n_turns:
            ids, mask = (np.concatenate(x) for x in zip(*chunks, strict=True))
            if part == 0:
                ids, mask = np.insert(ids, 0, BOS), np.insert(mask, 0, False)
            done.append((now, part, n_turns, ids, mask))
            size += len(ids)
        chunks.clear()

    for batch in batches:
        ids, mask = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)).tolist()
        begun = last = 0
        for conv, end in zip(batch.column(0).to_pylist(), ends, strict=True):
            if n_turns == 0 or conv != now or n_turns >= most_turns or n_ids >= most_ids:
                chunks.append((ids[begun:last], mask[begun:last]))
                close()
                now, part = conv, part + 1 if n_turns and conv == now else 0
                n_turns = n_ids = 0
                begun = last
                if size >= most_ids:
                    yield told()
                    size = 0
            n_turns, n_ids, last = n_turns + 1, n_ids + end - last, end
        chunks.append((ids[begun:], mask[begun:]))
    close()
    if done:
        yield told()


def format_chats(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", most_turns: int = 4096, most_ids: int = 1 << 20) -> DataFrame:
    """(conv_id, part, n_turns, ids, loss_mask) of each conversation, turns in order.

    A conversation is one row, part 0.  Where it has more than ``most_turns`` turns or ``most_ids`` ids it goes on in
    parts 1, 2 and so on, cut between turns: put one after another they are the sequence, and none is
    larger than these and a turn.  So it is with all rows whose conv_id is null, which are a conversation like any other.

    ``tokenizer`` is the path of a byte-level tiktoken file of at most 50,257
    ids that every executor has.  Null roles and texts are empty; equal
    turns are ordered by role and text, null turns come first; repeated rows are
    turns of their own.  Other columns are not read; no rows give none.  Rows are encoded where they lie, sorted by
    conversation and turn, and put together as they come, so that a task holds one part of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, roles = _tokenizer(tokenizer), {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                role, text = part.column(2).to_pylist(), part.column(3).to_pylist()
                for r in set(role) - roles.keys():
                    roles[r] = encoder.encode_ordinary(escape(r))
                found = [encoder.encode_ordinary(escape(t)) for t in text]
                turns = [assemble([([OPEN], False), (roles[r], False), ([CLOSE], False), (ids, r == loss_role), ([EOS], False)]) for r, ids in zip(role, found, strict=True)]
                if len(roles) > 10_000:
                    roles.clear()
                ends = pa.array(np.cumsum([0, *(len(ids) for ids, _ in turns)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[i] for t in turns]))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], ["conv_id", "turn", "role", "text", "ids", "mask"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parts(batches, most_turns, most_ids)

    column = lambda c: F.col(f"`{c}`")
    text = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    plain = rows.select(column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = plain.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, mask array<boolean>")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(put_together, "conv_id long, part long, n_turns long, ids array<int>, loss_mask array<boolean>")


def read_back(ids: list[int], mask: list[bool], decode) -> tuple[list[tuple[str, str]], list[str], str]:
    """(turns, texts under the loss, formatted string) of one assembled conversation."""
    pieces, formatted, turns, losses = [], [], [], []
    ids, mask = np.asarray(ids), np.asarray(mask, bool)
    marks = np.flatnonzero(ids >= FIRST_RESERVED).tolist()
    for at, end in zip(marks, [*marks[1:], len(ids)], strict=True):
        content = decode(ids[at + 1 : end].tolist()) if end > at + 1 else ""
        formatted += [CONTROL[ids[at] - FIRST_RESERVED], content]
        pieces.append((ids[at], unescape(content)))
        held = mask[at + 1 : end]
        if held.any():
            losses.append(unescape(decode(ids[at + 1 : end][held].tolist())))
    for (mark, role), (_, text) in zip(pieces, pieces[1:], strict=False):
        if mark == OPEN:
            turns.append((role, text))
    return turns, losses, "".join(formatted)


def digests(chats: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted conversations say when read back: counts and digests of turns, loss text and string.

    Parts (conv_id, part, ids, loss_mask) are read one after another, so that a conversation of any size is digested
    without being held.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _tokenizer(tokenizer).decode
        now, begun, done = None, False, []
        n_turns = loss_chars = formatted_chars = 0
        said, lost = hashlib.sha256(), hashlib.sha256()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate(kinds)], names)
            done.clear()
            return made

        for batch in batches:
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n_turns, said.hexdigest(), loss_chars, lost.hexdigest(), formatted_chars))
                    now, begun = conv, True
                    n_turns = loss_chars = formatted_chars = 0
                    said, lost = hashlib.sha256(), hashlib.sha256()
                turns, losses, formatted = read_back(ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False), decode)
                said.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                lost.update("".join(losses).encode())
                n_turns, loss_chars, formatted_chars = n_turns + len(turns), loss_chars + sum(map(len, losses)), formatted_chars + len(formatted)
            yield told()
        if begun:
            done.append((now, n_turns, said.hexdigest(), loss_chars, lost.hexdigest(), formatted_chars))
        yield told()

    ordered = chats.select("conv_id", "part", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "ids", "loss_mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
