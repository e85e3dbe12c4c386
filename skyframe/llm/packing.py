"""Best-fit packing of token pieces by bin completion, planned on the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small

Run = tuple[tuple[int, ...], int]  # the lengths in one sequence, and how many sequences are filled so


# ---------------------------------------------------------------- planning


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Sequences that any packing needs: the best of the volume bounds in which lengths under k are sand (L2)."""
    n, size = counts.astype(np.int64), np.arange(cap + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // cap)
    for k in range(1, cap // 2 + 1):
        if not n[k]:
            continue
        wide, half = int(n[cap - k + 1 :].sum()), slice(cap // 2 + 1, cap - k + 1)
        mid = int(n[half].sum())
        room = mid * cap - int((n[half] * size[half]).sum())
        low = slice(k, cap // 2 + 1)
        best = max(best, wide + mid + max(0, -(-(int((n[low] * size[low]).sum()) - room) // cap)))
    return best


def best_fit(counts: np.ndarray, cap: int) -> list[Run]:
    """Best-fit decreasing over the histogram: equal lengths are placed together."""
    open_: dict[int, list[list]] = {}  # room left -> [lengths, how many sequences]
    rooms = np.zeros(cap + 1, dtype=np.int64)

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        open_.setdefault(room, []).append([lengths, n])
        rooms[room] += n

    for length in range(cap, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = cap // length
                if left >= each:
                    put(cap - each * length, (length,) * each, left // each)
                    left %= each
                else:
                    put(cap - left * length, (length,) * left, 1)
                    left = 0
                continue
            room = int(fits[0]) + length
            run = open_[room][-1]
            each = min(room // length, left)
            n = min(run[1], left // each)
            rooms[room] -= n
            run[1] -= n
            if not run[1]:
                open_[room].pop()
            put(room - each * length, run[0] + (length,) * each, n)
            left -= n * each
    return [(tuple(lengths), n) for runs in open_.values() for lengths, n in runs]


def dominates(a: tuple[int, ...], b: tuple[int, ...], tries: int = 2000) -> bool:
    """Whether the pieces of ``b`` fit into those of ``a``, each of which may take several or none; then what ``b`` leaves over can do whatever ``a``'s can.

    Gives up, and says no, after ``tries`` placements, so a filling is only ever dropped for a proof.
    """
    if sum(b) > sum(a):
        return False
    rooms = list(a)

    def place(i: int) -> bool:
        nonlocal tries
        if i == len(b):
            return True
        for room in sorted({r for r in rooms if r >= b[i]}):
            tries -= 1
            if tries < 0:
                return False
            j = rooms.index(room)
            rooms[j] -= b[i]
            if place(i + 1):
                return True
            rooms[j] += b[i]
        return False

    return place(0)


def fillings(left: np.ndarray, room: int, waste: int, steps: int) -> list[tuple[int, ...]]:
    """The undominated ways to fill ``room`` beside the largest piece that waste at most ``waste``, fullest first, larger pieces first.

    Depth-first over the lengths in falling order.  A branch ends where even all smaller pieces can't use up enough of the room.  All
    fillings are looked at, or as many as ``steps`` additions of a piece lead to; those that another one dominates are left out.
    """
    sizes = [int(s) for s in np.flatnonzero(left[: room + 1])[::-1]]
    have = [int(left[s]) for s in sizes]
    under = np.concatenate([np.cumsum([s * n for s, n in zip(sizes[::-1], have[::-1], strict=True)])[::-1], [0]])  # all pieces from here on
    place = np.searchsorted(-np.asarray(sizes, dtype=np.int64), -np.arange(room + 1))  # the first size at or under each room
    found: list[tuple[int, ...]] = []

    def go(room_: int, start: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        i, whole = max(start, int(place[room_])), True
        while i < len(sizes) and steps > 0:
            if room_ - int(under[i]) > waste:
                return
            if have[i]:
                whole = False
                steps -= 1
                have[i] -= 1
                go(room_ - sizes[i], i, (*chosen, sizes[i]))
                have[i] += 1
            i = max(i + 1, int(place[room_]))
        if whole and room_ <= waste:
            found.append(chosen)

    go(room, 0, ())
    found.sort(key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def plan(counts: np.ndarray, cap: int, *, nodes: int = 4000, steps: int = 400) -> list[Run]:
    """Fill sequences of ``cap`` from ``counts[length]`` pieces by bin completion.

    Branch and bound: the largest piece left is completed with each undominated filling in
    turn, as many times as the lengths allow, then once less, and so on.  A branch is cut where its waste so far leaves no better total
    than the incumbent, which is best-fit decreasing at first.  Ends at the lower bound, when all branches are done (the packing is then
    the best there is, if no enumeration ran out of ``steps``), or after ``nodes`` nodes with the best packing so far; ``pack_pieces`` tells
    the bound beside the result.  Works on at most ``cap`` distinct lengths, whatever the number of pieces.
    """
    counts = np.asarray(counts, dtype=np.int64)
    total = int((counts * np.arange(cap + 1)).sum())
    if not total:
        return []
    bound = lower_bound(counts, cap)
    best = best_fit(counts, cap)
    score = sum(n for _, n in best)

    def choices(left: np.ndarray, allowed: int) -> Iterator[tuple[tuple[int, ...], int]]:
        big = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[big] -= 1
        for filling in fillings(rest, cap - big, allowed, steps):
            pattern = (big, *filling)
            need = np.bincount(pattern, minlength=cap + 1)
            for n in range(int((left[need > 0] // need[need > 0]).min()), 0, -1):
                yield pattern, n

    spare = lambda waste: (score - 1) * cap - total - waste
    # frames of (counts left, runs so far, waste so far, sequences so far, what is still to try)
    frames: list[tuple] = [(counts, None, 0, 0, choices(counts, spare(0)))]
    while frames and nodes > 0 and score > bound:
        left, runs, waste, bins, ways = frames[-1]
        pattern, n = next(ways, (None, 0))
        if pattern is None:
            frames.pop()
            continue
        lost = (cap - sum(pattern)) * n
        if lost > spare(waste):
            continue
        nodes -= 1
        left, runs = left - np.bincount(pattern, minlength=cap + 1) * n, (runs, (pattern, n))
        if left.any():
            frames.append((left, runs, waste + lost, bins + n, choices(left, spare(waste + lost))))
        elif bins + n < score:
            score, best = bins + n, []
            while runs is not None:
                runs, run = runs
                best.append(run)
    return best


# ---------------------------------------------------------------- tokens


def _encoder(vocabulary: str):
    """ids(text) by the byte-level BPE of a ``tokenizers`` file.

    The same merges run through tiktoken where its rank file lies beside the vocabulary (four times as
    fast, equal ids; tests compare them).  Its regular expressions overflow on runs of about a million blanks, so texts that could hold one
    go to ``tokenizers``, for the same ids.
    """
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state: dict = {}

    def slow(text: str) -> np.ndarray:
        if "t" not in state:
            state["t"] = Tokenizer.from_file(vocabulary)
            state["t"].encode_special_tokens = True
        return np.asarray(state["t"].encode(text, add_special_tokens=False).ids, dtype="<u4")

    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        return slow(text) if len(text) > 400_000 else fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return ids


def cut(docs: DataFrame, vocabulary: str, *, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut so that only the first piece is short.

    A null or empty text is one piece with the end id alone; repeated rows are cut each; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(vocabulary)
        for batch in small(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            for at, text in enumerate(batch.column(1).to_pylist()):
                all_ids = np.append(ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                n = -(-len(all_ids) // cap)
                first = len(all_ids) - (n - 1) * cap
                for k in range(n):
                    start = 0 if k == 0 else first + (k - 1) * cap
                    length = first if k == 0 else cap
                    for column, value in zip(rows, (at, k, start, length, zlib.crc32(all_ids[start : start + length])), strict=True):
                        column.append(value)
            owner = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([owner, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, *, cap: int = 2048, rows_per_salt: int = 500) -> DataFrame:
    """Give every row of ``pieces`` (doc_id, piece, length, ...) a sequence_id and an offset in it.

    The histogram of lengths has at most ``cap`` rows, so it is planned on the driver.  Pieces are then numbered
    within their length, first inside (length, salt) and then by the sums of the salts before; a length has as
    many salts as its count calls for, so one that half of all pieces have is still numbered by many
    tasks, and there are at most 200,000 salts besides one for each length.  The number
    picks the piece's place in the plan.  Null ids and repeated rows are pieces like others; no pieces give an empty result.  Each row
    tells how many sequences the whole plan has (``n_sequences``) and how many any plan needs (``least_sequences``).
    """
    pieces = checkpoint(pieces)
    counts = np.zeros(cap + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    each = max(rows_per_salt, int(counts.sum()) // 200_000)
    salts = pieces.sparkSession.createDataFrame([(length, int(-(-n // each))) for length, n in enumerate(counts.tolist()) if n] or [(0, 1)], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    places: list[tuple[int, int, int, int]] = []  # length, first number, first sequence, offset
    given, sequence, least = np.zeros(cap + 1, dtype=np.int64), 0, lower_bound(counts, cap)
    for pattern, n in plan(counts, cap):
        offset = 0
        for length in pattern:
            places.append((length, int(given[length]), sequence, offset))
            given[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast((table, (table[:, 0] << 44) | table[:, 1]))

    before = sums.selectExpr("length", "salt", "sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before")
    numbered = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece) - 1 AS nth")
    numbered = numbered.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = shared.value
        for b in batches:
            length, nth = b["length"].to_numpy(), b["nth"].to_numpy()
            at = np.searchsorted(keys, (length << 44) | nth, side="right") - 1
            ids = table[at, 2] + nth - table[at, 1] if len(at) else np.zeros(0, np.int64)
            offset = table[at, 3] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(ids), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = numbered.mapInArrow(settle, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumns({"n_sequences": F.lit(sequence).cast("long"), "least_sequences": F.lit(least).cast("long")})


def pack_documents(docs: DataFrame, vocabulary: str, *, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of ``cap`` tokens as bin completion finds.

    A null or empty text is one piece with the end id alone.  Documents with equal ids, or repeated rows,
    are packed each for itself.  An empty table gives an empty result.
    """
    return pack_pieces(cut(docs, vocabulary, cap=cap, id_col=id_col, text_col=text_col), cap=cap)
