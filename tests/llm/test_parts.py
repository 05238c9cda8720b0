"""Parsers, alignment, clustering and covering on small inputs."""

import random

import numpy as np
import pytest

from tapeloom.llm import htmltext, linededup, lm, pieces, pii, quality, simhash, toxicity
from tests.llm import brute


@pytest.mark.parametrize("alphabet", ["a1 .@+-()2b%_é9\n", "0123456789.", "0123456789 -+()", "ab@.-"])
def test_pii_parsers_equal_the_patterns(alphabet):
    rng, anchors = random.Random(1), pii.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        base = [s for s in pii.find(text, anchors) if s.kind in pii.BASE]
        assert pii.joined(base) == ",".join(brute.base_pii(text)[1])


def test_pii_added_kinds():
    anchors = pii.automaton()
    text = 'See https://a.example/x?y=1. IBAN: DE89 3704 0044 0532 0130 00, api_key = "9f86d081884c7d65", 12 Long Street, Hauptstraße 5'
    found = {(s.kind, text[s.start : s.end]) for s in pii.find(text, anchors)}
    assert {("url", "https://a.example/x?y=1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "9f86d081884c7d65"), ("address", "12 Long Street"), ("address", "Hauptstraße 5")} <= found


def test_pii_long_texts_stay_linear():
    text = "@".join(["a" * 50] * 20_000) + "1" * 200_000 + "." + "+1" * 50_000
    assert isinstance(pii.find(text, pii.automaton()), list)


def test_pieces_equal_the_library():
    model = pieces.chunk_model(pieces.default_model())
    table, rng = pieces.chunk_table(model, 500), random.Random(2)
    texts = ["", " ", "  ", "   a ", "▁", "▁▁ ", " ▁ ", "</s> <s>", "<0x0A>", "\x00", "a" * 20_000, "é " * 5_000]
    texts += ["".join(rng.choice(" \n\t▁  aé日😀<s>\x01x.ﷺ") for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    for text in texts:
        found = [table[c] for c in pieces.chunks(text)]
        ids = [i for f in found for i in f[0]]
        assert ids == model.encode(text) and "".join(f[3] for f in found)[1:] == (model.decode(ids) if ids else "")


def test_quality_repeats_and_lines():
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a a a ", "# ", "\n", "é\x0b"]) for _ in range(rng.randrange(0, 80)))
        assert quality.judge(text, quality.Rules())[:6] == brute.base_quality(text)
    good = "The quick fox ran over hills and dales until evening came at last and rest was near. " * 1
    words = " ".join(f"w{i}" for i in range(80))
    assert quality.judge(f"{good}\n{words}.", quality.Rules())[6]
    noisy = quality.judge(f"{words}.\nhome | about | news | contact | login", quality.Rules())
    assert noisy[6] and noisy[7] == 1 and "home" not in noisy[8]
    assert not quality.judge(" ".join(f"w{i}###" for i in range(80)), quality.Rules())[6]


def rising(pairs):
    best = [1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        best[k] = 1 + max((best[m] for m in range(k) if pairs[m][0] < i), default=0)
    return max(best, default=0)


def test_alignment():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(1, 15) for _ in range(rng.randrange(0, 14))]
        b = [rng.randrange(1, 15) for _ in range(rng.randrange(0, 14))]
        pairs = [(a.index(h), j) for j, h in enumerate(b) if a.count(h) == 1 and b.count(h) == 1]
        assert len(linededup.anchors(a, b)) == rising(pairs)
        m = linededup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
    assert linededup.aligned([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert linededup.common_blocks([1, 2, 3], [1, 2, 9, 3], [3, 3, 9, 2], 5) == [0, 1]


def test_long_documents_align_in_time():
    a = list(range(1, 60_000))
    assert len(linededup.aligned(a, a[:30_000] + [0] + a[30_000:])) == len(a)


def test_every_pair_in_the_radius_collides():
    rng = random.Random(5)
    masks = [m & ((1 << 64) - 1) for m in simhash.masks()]
    assert len(masks) == 15
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("direct", [4, 1024])
def test_forest_joins_what_links_join(monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(6)
    for _ in range(60):
        seeds = [rng.getrandbits(64) for _ in range(3)]
        values = sorted({s ^ sum(1 << rng.randrange(0, 12) for _ in range(rng.randrange(0, 6))) & ((1 << 64) - 1) for s in seeds for _ in range(12)})
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in simhash.forest(np.array(values, dtype=np.uint64)):
            root[find(i)] = find(j)
        want = {}
        for d, f, c in brute.components([(i, f) for i, f in enumerate(values)]):
            want[d] = c
        for i in range(len(values)):
            for j in range(i):
                assert (find(i) == find(j)) == (want[i] == want[j])


def test_fingerprints():
    for text in ["", "one", "One two", "a b c", "a b c d e f g", "É x É x É x", "w " * 100_000]:
        assert simhash.fingerprint_of(text.encode()) & ((1 << 64) - 1) == brute.fingerprint(text)


def test_exchange_finds_word_classes():
    rng = np.random.default_rng(7)
    pairs = np.zeros((21, 21))
    # two languages that hardly mix
    pairs[:10, :10] = rng.integers(5, 20, (10, 10))
    pairs[10:20, 10:20] = rng.integers(5, 20, (10, 10))
    of = lm.exchange(pairs, classes=3)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2


def test_counterfactuals_hold_down_identity_terms():
    import pyarrow as pa

    # feature 0 is an insult, 1 and 2 are identity terms; toxic documents happen to name group 1
    rows = []
    for i in range(60):
        toxic = i % 3 == 0
        rows.append({"id": i, "y": int(toxic), "nth": 0, "own": [], "other": None})
        own = ([0] if toxic and i % 2 else []) + ([1] if toxic else [2] if i % 5 == 0 else [])
        rows.append({"id": i, "y": int(toxic), "nth": 1, "own": own, "other": [{1: 2, 2: 1}.get(f, f) for f in own]})
    table = pa.Table.from_pylist(rows, pa.schema([("id", pa.int64()), ("y", pa.int32()), ("nth", pa.int32()), ("own", pa.list_(pa.int32())), ("other", pa.list_(pa.int32()))]))
    free, _ = toxicity.fit(table, 3, penalty=0.0)
    held, _ = toxicity.fit(table, 3, penalty=50.0)
    assert abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2]) and held[0] > 1


def test_swaps_stay_in_their_set():
    table = toxicity.swaps()
    assert toxicity.counterfactual(["the", "women", "sang"], table) == ["the", "men", "sang"]
    assert toxicity.counterfactual(["the", "cat"], table) is None


def test_suffix_runs_number_equal_runs_alike():
    rng = random.Random(8)
    for _ in range(100):
        streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(4)]
        seen = {}
        for s, ranks in zip(streams, htmltext.suffix_runs(streams, 3)):
            assert len(ranks) == len(s)
            for p, r in enumerate(ranks.tolist()):
                if p + 3 > len(s):
                    assert r == -1
                else:
                    assert seen.setdefault(r, tuple(s[p : p + 3])) == tuple(s[p : p + 3])
        assert len(set(seen.values())) == len(seen)


def test_html_zones():
    page = ('<head><title>t</title><script>var a="<article>no</article>"</script></head><body><header>top</header><nav><ul><li>menu</ul></nav>'
            '<article class="has-sidebar"><header><h1>A &amp; B</h1></header><p>one<br>two &lt;x&gt;<aside>side</aside><p class="notice">n</p><p>three<!-- c --></p>'
            '<form><input>f</form><div id="comments">c</div></article><div class="ad">ad</div><footer>foot')
    assert [t for z, t in htmltext.blocks(page) if z == "main"] == ["A & B", "one two <x>", "three"]
    for odd in ["", "<", "<!--", "<script>", "a<b", "<p title='x>y", "&am &amp &#0;", "</div></p>"]:
        htmltext.blocks(odd)


def test_portions_keep_every_row_in_order():
    import pyarrow as pa

    from tapeloom.llm.common import portions

    texts = ["a" * n for n in (0, 5, 50, 3, 3, 3, 200, 0, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["i", "t"])
    parts = list(portions(iter([batch, batch.slice(0, 0)]), 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10))
    assert all(p.num_rows <= 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 for p in parts)
