import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import no_documents, odd_documents

from palimpsest.llm.packing import WordIds, fullest, minimum_bin_slack, pack_documents

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, capacity):
    want = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want[d, k, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_odd_documents(spark, tokenizer):
    df = odd_documents(spark, ["it's <|endoftext|> DON'T é x́ 12 İstanbul ΣΑΣ ﬁ ß", "a" * 5000])
    check(pack_documents(df, PATH).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer, 2048)
    assert pack_documents(no_documents(spark), PATH).count() == 0


def test_whole_table_needs_few_sequences(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check(pack_documents(df, PATH).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer, 2048)
    assert used <= least + 1


def test_words_alone_give_the_ids_of_texts(tokenizer):
    rng = random.Random(1)
    signs = "aZé É.,!*$'́ \x1c\t\n9ßİσΣ|%s't<>"
    own = WordIds(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        assert own.of(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_fullest_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randrange(1, 40)
        counts = {rng.randrange(1, 45): rng.randrange(1, 5) for _ in range(rng.randrange(1, 7))}
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        uses = fullest(dict(sorted(counts.items(), reverse=True)), capacity)
        assert sum(n * k for n, k in uses) == max(s for s in sums if s <= capacity)
        assert all(k <= counts[n] for n, k in uses)


def test_schedule_places_every_piece():
    rng = random.Random(4)
    counts = {n: rng.randrange(0, 2000) for n in [*range(1, 41), 100]}
    schedule = minimum_bin_slack(counts, 100)
    placed = Counter()
    for bins, uses in schedule:
        assert sum(n * k for n, k in uses) <= 100
        for n, k in uses:
            placed[n] += bins * k
    assert placed == Counter({n: c for n, c in counts.items() if c})
    total = sum(n * c for n, c in counts.items())
    assert sum(b for b, _ in schedule) <= -(-total // 100) + 1
