"""Near-duplicates of the pipeline, compared with all pairs."""

import random

from tapeloom.llm import neardup, simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_first_of_group_links_what_jaccard_links(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice((30, 120, 300)))]
        for copy in range(6):
            own = list(text)
            for _ in range(max(1, len(own) * copy // 120)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(400)}"
            rows.append((f"d{group:02d}-{copy}", " ".join(own)))
    rows += [("e1", ""), ("e2", None), ("s1", "two words"), ("s2", "Two  words"), ("d00-0", "another text of the same id here")]
    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                bits = (simhash.fingerprint_of((rows[i][1] or "").encode()) ^ simhash.fingerprint_of((rows[j][1] or "").encode())) & (2**64 - 1)
                far += bits.bit_count() > simhash.RADIUS
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == want
    assert far > 10
    kept = {r.doc_id for r in neardup.first_of_group(df).collect()}
    assert kept == {d for d, c in want if d == c}


def test_hot_group_around_the_threshold(spark):
    """Hundreds of copies of one text with random edits: many pairs just above and just below the similarity."""
    from tests.llm import brute

    rng = random.Random(11)
    text = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        own = list(text)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 5, 6))):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    # a second text whose copies are all as far from each other as they can be and still linked by chains
    chain = [f"c{k}" for k in range(150)]
    for i in range(12):
        rows.append((1000 + i, " ".join([f"d{k}" for k in range(2 * i)] + chain[2 * i :])))
    want = brute.similar_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want
    assert 5 < len(set(want.values())) < 300


def test_the_stage_links_fingerprints_and_sets(spark):
    """Texts with edits all over: some pairs are within three bits only, some share 0.8 only."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = []
    for group in range(10):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((150, 250)))]
        for copy in range(8):
            own = list(text)
            for at in rng.sample(range(len(own)), copy * len(own) // 100):
                own[at] = f"x{rng.randrange(10**6)}"
            rows.append((100 * group + copy, " ".join(own)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(3000 + i, " ".join([passage] * 40 + [f"q{i}v{k}" for k in range(20)])) for i in range(6)]
    # two fingerprints of one set, and texts without words
    rows += [(2000, "a b c d e " * 9), (2001, "a b c d e " * 90), (2002, ""), (2003, None), (2003, "a text of the same id")]
    prints = [simhash.fingerprint_of((t or "").encode()) for _, t in rows]
    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    only = [0, 0]
    for i in range(len(rows)):
        for j in range(i):
            near = ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            only[0] += near and not alike
            only[1] += alike and not near
            if near or alike:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))
    assert min(only) > 0
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, radius=3).collect())
    assert got == want
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {d for d, c in want if d == c}
