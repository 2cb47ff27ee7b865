"""Set similarity join by parity sketches: pigeonhole on their parts, links confirmed on full shingle sets.

Every shingle flips one bit of its document's sketch, so two sketches differ in
at most as many bits as the sets have different shingles (their Hamming
distance bounds the symmetric difference from below).  A sketch is cut into
parts of 64 bits.  Two sets of a and b shingles with Jaccard >= p / q differ in
at most d = (a + b)(q - p) / (q + p) shingles, hence in at most d parts, and at
least one part that is not zero is equal in both as soon as one of them has
more than d of these.  In any order that is common to all sets it is enough that each
document keeps its first d + 1 parts that are not zero: of two sets with c
common parts, the first n - c + 1 of either meet.  The order is by the number of sets
that have a part, rarest first, so sets that share passages with many others, but
no link, mostly keep parts that no other set has.  A set with no more than d
such parts (many shingles in few parts, which only tiny sets have) keeps all
of them and a key common to all such sets.  Among the sets that have keys no link is left to chance.

Most sets are linked with nothing and need no keys: a linked set of n shingles
shares at least n p / q of them with its partner.  Of each set about 32 to 64 shingles,
those with the least hashes in proportion to the size of its band, are counted
over all sets; a set stays only if enough of them (the share, less six
standard deviations of such a sample) lie in other sets too.  Sets of up to 64
shingles are counted whole, without a margin; a larger linked one is left out with a chance below
1e-8.  So the keys of passages that many texts share are made only for texts that
consist of such passages.

Sizes are banded: the number of parts belongs to a band of sizes, bounds of which
double.  A pair meets in the band of its larger set, so a document
has parts for its own band and, if a partner may lie there, for the
next.  A document of n shingles has about 0.3 n to 0.5 n
keys, which are counted, and keeps fewer.

Classes, rounds and the confirmation on full sets are those of ``linked_sets``.

Defined cases: a null or word-less text has an empty set, links with nothing
and is its own component.  A text with fewer words than a shingle has its whole
word sequence as its one shingle.  Rows that repeat a doc_id each give a row
and are judged each by its own text.  A null doc_id never links or leads a class
that has another id.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from varaka.llm.linked_sets import Candidates, linked_sets
from varaka.llm.text import mix

#: largest size of the first band; bounds double
FIRST_BAND = 4
#: shingles that the largest set of a band has sampled, and the margin in standard deviations of their number
SAMPLED, DEVIATIONS = 64, 6
#: sets too full for their parts meet under this
CROWDED = np.uint64(0x452821E638D01377)


def bands_of(n: int, p: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(band, parts, most parts in which a linked pair differs) for each band in which a set of ``n`` shingles may meet a partner of its size or larger."""
    k = max(0, (n - 1).bit_length() - FIRST_BAND.bit_length() + 1)
    largest = n * q // p
    while k == 0 or FIRST_BAND << (k - 1) < largest:
        top = FIRST_BAND << k
        d = (n + min(top, largest)) * (q - p) // (q + p)
        if d:  # else only equal sets link, which are one class
            yield k, parts_of(top, p, q), d
        if top >= largest:
            return
        k += 1


def parts_of(size: int, p: int, q: int) -> int:
    return 9 * (2 * size * (q - p) // (q + p) + 1) // 8 + 6


def part_groups(shingles: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    """For each band in which a set may meet others: how many of its keys it may leave out, the most frequent ones, and the keys of its parts."""
    out = []
    high = shingles >> np.uint64(32)  # in the order of the shingles, so parts are too
    bit = np.uint64(1) << (shingles * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(58))
    for band, parts, d in bands_of(len(shingles), p, q):
        part = high * np.uint64(parts) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        bits = np.bitwise_xor.reduceat(bit, begin)
        at = np.flatnonzero(bits)
        keys = mix(bits[at] ^ mix(part[begin[at]] + np.uint64((band + 1) << 32)))
        if len(at) <= d:
            keys = np.append(keys, mix(CROWDED + np.array([band], np.uint64)))
        out.append(np.append(max(len(at) - d - 1, 0), keys.view(np.int64)))
    return out


def part_keys(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of the parts of a set, in all bands."""
    return np.concatenate([np.zeros(0, np.int64), *(g[1:] for g in part_groups(shingles, p, q))]).view(np.uint64)


def probes(shingles: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    """For each band in which a set may meet others: how many of the sampled shingles they must have too, and these."""
    n, out = len(shingles), []
    top = max(SAMPLED, 1 << (n - 1).bit_length()) if n else 0
    for size in (top, 2 * top) if n * q // p > top else (top,) if n else ():
        some = shingles if size == SAMPLED else shingles[: np.searchsorted(shingles, np.uint64((SAMPLED << 64) // size))]
        need = -(-n * p // q) if size == SAMPLED else int(np.ceil(len(some) * p / q - DEVIATIONS * (len(some) * p * (q - p)) ** 0.5 / q))
        out.append(np.append(max(need, 0), mix(some + np.uint64(size)).view(np.int64)))
    return out


def similar_documents(docs: DataFrame, shingle: int = 5, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key) for documents linked at Jaccard >= similar[0] / similar[1]."""
    p, q = similar

    def keys(sets: list[np.ndarray]) -> tuple[list[list[np.ndarray]], np.ndarray]:
        return [part_groups(s, p, q) for s in sets], np.zeros((len(sets), 0), np.int64)

    return linked_sets(docs, shingle, similar, Candidates(keys, [], longs=8, wide=True, probe=lambda sets: [probes(s, p, q) for s in sets])).select("doc_id", "n_shingles", "component_id", "text_key")
