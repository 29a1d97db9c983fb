"""Terms within a few edits, found by equal deletion variants and checked by distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.chunking import exploded
from veriframe.operators.joins import broadcast_if_small, is_small
from veriframe.operators.scan import spread
from veriframe.sources.shared import cut

#: The least lengths of a term from which one edit and two edits are allowed.
ONE_EDIT, TWO_EDITS = 3, 6
#: Variants are made of this many first characters: two terms within d edits have a variant of d deletions in common there, too.
PREFIX = 8
#: Shorter variants than any that an asked term has are left out.
LEAST = 2
#: Asked terms whose variants every task holds; with more, variants are joined.
HELD = 50_000
#: Odd factors of a hash's characters, one a place, and the bits of the table that tells which hashes needn't be searched.
FACTORS = np.random.default_rng(0).integers(0, 1 << 63, PREFIX, np.uint64) * np.uint64(2) + np.uint64(1)
TABLE_BITS = 22


def allowed_edits(term: Column) -> Column:
    return F.when(F.length(term) < ONE_EDIT, 0).when(F.length(term) < TWO_EDITS, 1).otherwise(2)


def _shortened(s: Column) -> Column:
    """Array of a string with each one of its characters left out."""
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))


def variants(term: Column, edits: Column) -> Column:
    """The term's beginning with up to ``edits`` (0 to 2) characters left out; at most 37 strings, whatever the term's length."""

    def of(p: Column) -> Column:
        return T.once(_shortened(p), lambda one: F.concat(F.array(p), F.when(edits > 0, one).otherwise(F.array().cast("array<string>")), F.when(edits > 1, F.flatten(F.transform(one, _shortened))).otherwise(F.array().cast("array<string>"))))

    return F.filter(F.array_distinct(T.once(F.substring(term, F.lit(1), F.lit(PREFIX)), of)), lambda v: F.length(v) >= LEAST)


def _hashes(terms: pa.Array) -> np.ndarray:
    """A row for each way to leave out none, one or two of PREFIX places: hashes of what is left of the terms' beginnings. Equal variants have equal hashes.

    Places beyond a term's end count nothing, so to leave them out is to leave out less.
    """
    beginnings = pc.utf8_slice_codeunits(terms, 0, PREFIX).to_numpy(zero_copy_only=False).astype(f"U{PREFIX}")
    chars = np.ascontiguousarray(beginnings).view(np.uint32).reshape(-1, PREFIX).T.astype(np.uint64)
    chars += np.arange(PREFIX)[:, None] < pc.utf8_length(terms).to_numpy()  # so that none but places beyond the end are zero
    # sums of the characters before each place, moved by as many places as are left out before
    moved = [np.vstack([np.zeros((1 + d, len(terms)), np.uint64), np.cumsum(chars[d:] * FACTORS[: PREFIX - d, None], axis=0)]) for d in range(3)]
    whole, one, two = moved
    rows = [whole[PREFIX]] + [whole[i] + one[PREFIX] - one[i + 1] for i in range(PREFIX)]
    rows += [whole[i] + one[j] - one[i + 1] + two[PREFIX] - two[j + 1] for j in range(PREFIX) for i in range(j)]
    return np.array(rows)


def _meeting(asked: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of tokens all (asked, token) whose beginnings have a variant with the same hash, and whose lengths differ by no more than the allowed edits."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = pc.utf8_length(asked).to_numpy()
        edits = np.where(lengths < ONE_EDIT, 0, np.where(lengths < TWO_EDITS, 1, 2))
        hashes = _hashes(asked)
        left_out = np.repeat([0, 1, 2], [1, PREFIX, len(hashes) - 1 - PREFIX])
        way, own = np.nonzero(left_out[:, None] <= edits)
        order = np.argsort(hashes[way, own], kind="stable")
        known, starts, counts = np.unique(hashes[way, own][order], return_index=True, return_counts=True)
        own, shift = own[order], np.uint64(64 - TABLE_BITS)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[known >> shift] = True
        for b in it:
            tokens = b.column(0)
            theirs = _hashes(tokens)
            way, token = np.nonzero(table[theirs >> shift])
            hashed = theirs[way, token]
            at = np.searchsorted(known, hashed)
            same = np.append(known, np.uint64(0))[at] == hashed
            at, token = at[same & (at < len(known))], token[same & (at < len(known))]
            term, token = own[spread(starts[at], counts[at])], np.repeat(token, counts[at])
            pairs = np.unique(token * len(asked) + term)
            token, term = pairs // max(1, len(asked)), pairs % max(1, len(asked))
            close = np.abs(lengths[term] - pc.utf8_length(tokens).to_numpy()[token]) <= edits[term]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(term[close])), tokens.take(pa.array(token[close]))], ["asked", "token"])

    return batches


def near_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(asked, token, distance): for distinct terms (asked) the tokens of ``vocabulary`` (token, each once) within their allowed edits.

    Asked terms and tokens meet where a variant of both is equal; nothing else is compared. Tokens below ONE_EDIT characters match as they are.
    """
    long, edits = cut(asked.filter(F.length("asked") >= ONE_EDIT).select("asked")), allowed_edits(F.col("asked"))
    if is_small(long, HELD):
        names = pa.array([r["asked"] for r in long.collect()], pa.string())
        met = vocabulary.filter("token IS NOT NULL").select("token").mapInArrow(_meeting(names), "asked string, token string")
    else:
        met = _joined(long, vocabulary).filter(F.abs(F.length("asked") - F.length("token")) <= edits).select("asked", "token").distinct()
    near = met.withColumn("distance", F.levenshtein("asked", "token", 2)).filter((F.col("distance") >= 0) & (F.col("distance") <= edits))
    short = asked.filter(F.length("asked") < ONE_EDIT).join(vocabulary.select("token"), F.col("asked") == F.col("token")).select("asked", "token", F.lit(0).alias("distance"))
    return near.unionByName(short)


def _joined(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    own = exploded(asked.select("asked", variants(F.col("asked"), allowed_edits(F.col("asked"))).alias("v")), "v", "variant")
    two = F.when(F.length("token") >= TWO_EDITS - 2, 2).otherwise(1)
    theirs = exploded(vocabulary.select("token", variants(F.col("token"), two).alias("v")), "v", "variant")
    return theirs.join(broadcast_if_small(cut(own)), "variant")


def expanded(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, token): every term of ``wanted`` (query_id, token) replaced by the tokens near it, each once a query."""
    asked = wanted.select(F.col("token").alias("asked")).distinct()
    found = near_terms(asked, vocabulary)
    return wanted.withColumnRenamed("token", "asked").join(broadcast_if_small(cut(found)), "asked").select("query_id", "token").distinct()
