import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagequarry.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def loads(rows):
    bins = defaultdict(list)
    for length, _, n, first, offset in rows:
        for k in range(n):
            bins[first + k].append((offset, length))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=25), st.sampled_from(["norm", "dot"]), st.integers(2, 50), st.integers(2500, 4000))
def test_plan_places_every_piece_once_within_all_capacities(counts, rule, most, attention):
    rows = packing.plan(counts, 50, most, attention, rule)
    ranks = defaultdict(list)
    for length, rank, n, _, _ in rows:
        ranks[length] += range(rank, rank + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for held in loads(rows).values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 50 and len(held) <= most and sum(x * x for _, x in held) <= attention


def test_plan_is_near_the_bound_and_small():
    rng = np.random.default_rng(1)
    counts = dict(zip(range(1, 1024), rng.integers(1, 2000, 1023).tolist(), strict=True))
    rows = packing.plan(counts, 1024, 1024, 1024**2)
    # no two pieces above half a sequence share one, so their number is a bound too
    bound = max(-(-sum(k * n for k, n in counts.items()) // 1024), sum(n for k, n in counts.items() if k > 512))
    assert len(loads(rows)) <= 1.01 * bound
    assert len(rows) < 40_000


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan({10: 1}, 20, 5, 50)


def test_pack_on_odd_rows(odd):
    rows = packing.pack(odd, capacity=64).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 64
    want = []
    for d in odd.collect():
        ids = [*LIBRARY.encode(d.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [500_000, 0])
def test_sequences_hold_the_ids_of_their_pieces(odd, monkeypatch, keys):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", keys)
    rows = packing.pack(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), capacity=64).collect()
    sequences = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == 4 * r.offset and len(r.ids) == 4 * r.length
        sequences[r.sequence_id] += r.ids
    for d in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.piece)
        held = b"".join(sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] for r in own)
        assert np.frombuffer(held, "<u4").tolist() == [*LIBRARY.encode(d.text or "", add_special_tokens=False).ids, 2]
