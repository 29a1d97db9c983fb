"""Products of blocks of vectors inside tasks, in tiles of bounded size; Spark deals the blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of a product that are held at a time, and components of pairs that are scored at a time.
TILE = 1 << 22
#: What a score from a product may differ from the one that is ranked, by rounding: scores are ranked by nine digits.
SLACK = 1e-8


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return pc.list_flatten(column).to_numpy().reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows of a times all of b), TILE elements at a time."""
    step = max(1, TILE // max(1, len(b)))
    for start in range(0, len(a), step):
        yield start, a[start : start + step] @ b.T


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component on, as ``functions.vectors.dot`` does."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


def best_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From (query_id, embedding, ...) and (chunk_id, embedding, ...): (query_id, chunk_id, score) of all pairs that can be among a query's k
    best of this block; of pairs that score the same, those of the k greatest ids."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids = left.column("query_id").combine_chunks(), right.column("chunk_id").combine_chunks()
        found_i, found_j, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            q, x = matrix(left.column("embedding")), matrix(right.column("embedding"))
            lengths_q, lengths_x = np.sqrt(_summed(q, q)), np.sqrt(_summed(x, x))
            place = np.empty(len(x), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(x))
            few, width = min(k, len(x)), max(1, TILE // q.shape[1])
            for start, tile in tiles(unit(q), unit(x)):
                least = np.partition(tile, len(x) - few, axis=1)[:, len(x) - few]
                i, j = np.nonzero(tile >= least[:, None] - SLACK)
                i += start
                dots = [_summed(q[i[s : s + width]], x[j[s : s + width]]) for s in range(0, len(i), width)]
                score = np.concatenate(dots) / (lengths_q[i] * lengths_x[j])
                order = np.lexsort((place[j], score, i))
                i, j, score = i[order], j[order], score[order]
                # the row k places on is of the same query and score: k greater ids come before this one
                rest = np.zeros(len(i), bool)
                rest[: len(i) - few] = (i[few:] == i[: len(i) - few]) & (score[few:] == score[: len(i) - few])
                found_i.append(i[~rest])
                found_j.append(j[~rest])
                scores.append(score[~rest])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        return pa.table({"query_id": asked.take(pa.array(i)), "chunk_id": ids.take(pa.array(j)), "score": np.concatenate(scores)})

    return best
