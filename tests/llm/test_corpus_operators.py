"""Substring dedup, SimHash, mixing, packing, top-k and URL filters beside brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, documents, prose
from tokenizers import Tokenizer

from dqspark.llm import mixing, substrings, urls
from dqspark.llm.kdtree import top_k
from dqspark.llm.mixing import drawn, mix, mixed_blocks, mixed_documents, permuted, targets
from dqspark.llm.packing import LENGTH, WordTokens, best_cuts, pack, word_tokens
from dqspark.llm.queries import tokenizer_file
from dqspark.llm.simhash import fingerprint, keep_one, simhash_components


def removed(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        cut = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                cut[p : p + length] = [True] * length
        spans = sum(c and not (p and cut[p - 1]) for p, c in enumerate(cut))
        out[i] = (len(b), sum(cut), spans, bytes(x for x, c in zip(b, cut) if not c))
    return out


@pytest.mark.parametrize("chunk,bucket,batch,shard", [(4 << 20, 8 << 20, 1 << 18, 1 << 16), (3000, 5000, 900, 400)])
def test_substrings(spark, monkeypatch, chunk, bucket, batch, shard):
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("BATCH", batch), ("SHARD", shard)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(1)
    texts = [t if t is None or len(t) < 5000 else t[:40_000] for t in awkward(2)]
    passage, other = prose(rng, 12), "ab" * 60
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 15)), passage[rng.randint(0, 30) :], other[: rng.randint(0, 120)], "日本語" * rng.randint(0, 20)]
        rng.shuffle(parts)
        texts.append("".join(parts))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = removed(list(zip(ids, texts)))
    rows = substrings.remove_repeats(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_merged_transforms_order_all_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        depth = rng.choice([3, 5, 8])
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(depth, 20))) for _ in range(25)})
        ids = np.array([rng.randint(0, 99) for _ in texts])
        least = {}
        for t, i in zip(texts, ids.tolist()):
            for p in range(len(t) - depth + 1):
                least[t[p : p + depth]] = min(least.get(t[p : p + depth], i), i)
        got, windows = substrings.smallest_ids(texts, ids, depth, rng.choice([8, 40, 10_000]))
        assert windows.tolist() == [len(t) - depth + 1 for t in texts]
        assert got.tolist() == [least[t[p : p + depth]] for t in texts for p in range(len(t) - depth + 1)]


def stretches(texts, buckets=1):
    chunk = substrings.Chunk.load(substrings.Chunk.dump(range(len(texts)), texts))
    return substrings.Stretches(chunk, np.unique(chunk.anchors()[0]), buckets), chunk


def test_a_line_of_many_documents_is_sent_once():
    line, sizes = prose(random.Random(6), 30).encode(), []
    for n in (100, 5000):
        found, chunk = stretches([b"%d " % i + line for i in range(n)])
        assert len(found.place) >= 5 * n
        middle = [t for t in (chunk.data[a : a + z].tobytes() for a, z in zip(found.begins, found.sizes)) if t in line]
        assert len(middle) == len(set(middle))
        ((_, message),) = stretches([line] * n)[0].messages(chunk.data)
        sizes.append(len(message))
    assert sizes[1] <= sizes[0] + 20


def test_only_stretches_with_a_common_side_are_merged():
    rng = random.Random(7)
    anchor = b"0123456789abcdef"
    sides = [bytes(rng.choice(b"xy") for _ in range(34)) for _ in range(12)]
    texts = list({rng.choice(sides)[rng.randint(0, 34) :] + anchor + rng.choice(sides)[: rng.randint(0, 34)] for _ in range(200)})
    texts = [t for t in texts if len(t) >= 50]
    kept = substrings.may_share(texts, np.array([t.index(anchor) for t in texts]), np.zeros(len(texts), int))
    own = [{t[i : i + 50] for i in range(len(t) - 49)} for t in texts]
    shares = [any(x & y for y in own if y is not x) for x in own]
    assert all(k or not s for k, s in zip(kept.tolist(), shares)) and any(shares)
    chance = [b"%034d" % rng.randrange(10**34) + anchor + b"%034d" % rng.randrange(10**34) for _ in range(50)]
    assert not substrings.may_share(chance, np.full(50, 34), np.zeros(50, int)).any()


def test_a_round_of_the_merge_reads_eight_symbols(monkeypatch):
    rng, rounds = random.Random(8), []
    texts = [prose(rng, 20, 30).encode() for _ in range(40)]
    monkeypatch.setattr(substrings, "by_key", lambda keys, f=substrings.by_key: rounds.append(1) or f(keys))
    got, _ = substrings.smallest_ids(texts, np.arange(40), 50, 1000)
    least = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            least.setdefault(t[p : p + 50], i)
    assert got.tolist() == [least[t[p : p + 50]] for t in texts for p in range(len(t) - 49)]
    assert len(rounds) <= 8


def test_repeated_and_null_ids_keep_their_copies(spark):
    text = "x" + prose(random.Random(4), 30)
    rows = substrings.remove_repeats(documents(spark, [text] * 4, ids=[3, 3, None, 7])).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed == len(text)) for r in rows)
    assert got == [(False, 3, False), (False, 3, False), (False, 7, True), (True, 0, True)]


def slow_fingerprint(text):
    import xxhash

    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    rng = random.Random(5)
    texts = [t if t is None else t[:20_000] for t in awkward(6)]
    base = prose(rng, 400).split()
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 60).upper(), "Ä B c D", "ä b C d"]
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(links, prints)
    docs = documents(spark, texts)
    rows = simhash_components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_chains_and_repeated_rows(spark):
    from dqspark.llm.simhash import components as joined
    from dqspark.llm.simhash import links

    rng = random.Random(7)
    prints = [0, -1, 1 << 62]
    for _ in range(6):  # chains of fingerprints, each three to five bits from the one before
        x = rng.getrandbits(64)
        for _ in range(15):
            for bit in rng.sample(range(64), rng.randint(3, 5)):
                x ^= 1 << bit
            prints.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in set(prints)], "fp bigint")
    near = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    pairs = links(df)
    assert {tuple(r) for r in pairs.collect()} == near
    nodes = {x for p in near for x in p}
    assert {r.node: r.root for r in joined(pairs).collect()} == components(near, nodes)
    rows = simhash_components(documents(spark, ["a b c d e"] * 3, ids=[4, 4, None])).collect()
    assert [r.component_id for r in rows] == [4, 4, 4]
    assert keep_one(documents(spark, ["a b c d e"] * 3, ids=[4, 4, None])).count() == 1
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_targets():
    assert targets([], []) == []
    assert targets([10, 10], [1, 1]) == [15.0, 15.0]
    got = targets([100, 10, 1000, 0], [3, 1, 2, 3])
    assert got[0] == 200 and got[1] == 20 and got[3] == 0 and abs(sum(got) - 1.5 * 1110) < 1e-9


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        i = np.arange(n, dtype=np.uint64)
        for key in (0, 5):
            out = permuted(i, np.full(n, n, np.uint64), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))


def test_mix(spark):
    rng = random.Random(8)
    texts = awkward(9) + [prose(rng, rng.randint(0, 300)) for _ in range(300)]
    sources = [rng.choice(["b", "a", "a", "a", "Z", "é", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    sizes = [len([w for w in (t or "").encode().split()]) for t in texts]
    order = sorted({s for s in sources if s}, key=str.encode) + [None]
    whole = [sum(n for n, s in zip(sizes, sources) if s == x) for x in order]
    want = dict(zip(order, targets(whole, [(3, 1, 2)[i % 3] for i in range(len(order))])))
    taken = collections.Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == whole[order.index(s)]
        assert abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 64
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert words == collections.Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_shard_counts_are_multinomial():
    """A source's counts add up to its slots in runs without gaps, and spread as thrown slots do."""
    slots, shards, squares = 400_000, 200, []
    for source in range(20):
        runs = [drawn(s, shards, source, slots) for s in range(shards)]
        at = 0
        for first, count in runs:
            assert first == at
            at += count
        assert at == slots
        squares.append(sum((c - slots / shards) ** 2 for _, c in runs) / (slots / shards))
    # chi-squared with 199 degrees of freedom each: mean 199, standard deviation 20
    assert abs(np.mean(squares) - 199) < 5 * 20 / 20**0.5
    assert drawn(0, 1, 3, 17) == (0, 17)


def test_blocks_of_shards(spark, monkeypatch):
    """Every shard holds the slots that it drew, and the documents' counts are those of the blocks."""
    monkeypatch.setattr(mixing, "SHARD", 64)
    rng = random.Random(21)
    docs = documents(spark, [None, ""] + [prose(rng, rng.randint(1, 200)) for _ in range(150)])
    _, sources = mixing.laid_out(docs)
    table = {r["rank"]: r for r in sources.collect()}
    shards = -(-sum(r.slots for r in table.values()) // 64)
    assert shards > 5
    want = collections.Counter()
    for rank, r in table.items():
        for s in range(shards):
            first, count = drawn(s, shards, rank, r.slots)
            for slot in range(first, first + count):
                again, at = divmod(slot, r.blocks)
                key = np.array([rank * 1_000_003 + again * 7_919 + 7], np.uint64)
                block = int(permuted(np.array([at], np.uint64), np.array([r.blocks], np.uint64), key)[0])
                want[s, r.source, block] += 1
    rows = mixed_blocks(docs).collect()
    assert [(r.shard, r.place) for r in rows] == sorted((r.shard, r.place) for r in rows)
    assert collections.Counter({(r.shard, r.source, r.block, r.place): 1 for r in rows}).total() == want.total()
    found = collections.Counter((s, x, b) for s, x, b, _ in {(r.shard, r.source, r.block, r.place) for r in rows})
    assert found == want
    taken, held = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        taken[r.doc_id] += r.words
        held[r.doc_id].add(r.shard)
    for r in mix(docs).collect():
        assert r.taken == taken[r.doc_id]
        assert (r.first_shard, r.last_shard) == ((min(held[r.doc_id]), max(held[r.doc_id])) if r.taken else (None, None))


def test_mix_of_repeated_rows(spark):
    docs = documents(spark, ["a b c"] * 5 + [None, ""], ids=[1, 1, 1, None, None, None, 2], sources=["s"] * 7)
    rows = mix(docs).collect()
    assert len(rows) == 7 and sum(r.size for r in rows) == 15 and all(r.taken <= 2 * r.size for r in rows)


def test_packing(spark):
    path = tokenizer_file("word_bpe_49k.json")
    texts = awkward(10) + ["a <|endoftext|> b", "Hello  WORLD's it'll x\x1cy　Σας ΟΔΟΣ é ̈x"] + [prose(random.Random(i), 200) for i in range(60)]
    rows = pack(documents(spark, texts), path).collect()
    tokens = word_tokens(path).tokenizer
    sizes, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sizes[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    assert set(docs) == set(range(len(texts)))
    for i, pieces in docs.items():
        ids = np.array([*tokens.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sizes.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= LENGTH
        padding += 0 if at & (at - 1) == 0 else LENGTH - at
    assert padding < 0.02 * sum(r.length for r in rows)


def test_cuts_are_the_cheapest():
    rng = random.Random(11)
    for _ in range(200):
        n, length = rng.randint(2, 50), 32
        places = np.array([0, *sorted(rng.sample(range(1, 200), n))])
        if np.diff(places).max() > length:
            continue
        cost = np.array([0] + [rng.choice([0, 3, 9]) for _ in range(n)])

        def pay(a, b):
            w = int(places[b] - places[a])
            return int(cost[b]) + (0 if w & (w - 1) == 0 else length - w)

        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + pay(i, j) for i in range(j) if places[j] - places[i] <= length)
        cuts = [int(np.searchsorted(places, c)) for c in best_cuts(places, cost, length)]
        assert sum(pay(a, b) for a, b in zip(cuts, cuts[1:])) == best[n]


def test_top_k(spark):
    rng = np.random.default_rng(12)
    vectors = [x.tolist() for x in rng.normal(size=(700, 8)).round(1)]
    vectors += [vectors[0]] * 60 + [[0.0] * 8, None, [None] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0] * 3, [2.0] * 3]
    ids = list(range(len(vectors)))
    rows = [(i, v, 1, "x") for i, v in zip(ids, vectors)] + [(None, vectors[1], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v int, rank string")
    got = collections.defaultdict(list)
    import dqspark.llm.kdtree as kdtree

    kdtree.SHARD, kdtree.BLOCK, old = 100, 7, (kdtree.SHARD, kdtree.BLOCK)
    try:
        for r in sorted(top_k(table, every=7).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
    finally:
        kdtree.SHARD, kdtree.BLOCK = old
    sound = {}
    for i, v in zip(ids, vectors):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound[i] = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
    for q in sound:
        if q % 7 == 0:
            scores = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert set(got) == {q for q in sound if q % 7 == 0}


def host_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[n:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), path


def rule_of(host, path):
    for rule, says in sorted(urls.RULES, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return rule, says
    return None, None


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">' for h in hosts) + "<a href='//Far.ORG'><a href=/own>"
    pages = [
        ("http://a.com/x", link("friend.org", "b.org")),
        ("http://WWW.Example.com/en/1?q#f", link()),
        ("https://x.example.com/en/1", link()),
        ("https://m.x.net/es/1", link("bad.org")),
        ("https://y.net/fr", link()),
        ("https://farm.org/p", link("m.x.net", "x.example.com")),
        ("https://friend.org?x=/es/", link("b.org")),
        ("https://b.org", None),
        ("https://lone.org/#a", ""),
        ("no url", link("a.com")),
        (None, link("a.com")),
        ("ftp://", ""),
        ("http://Ä.Com/é", None),
    ]
    rows = [(i, u, h, "z", 1) for i, (u, h) in enumerate(pages)] + [(None, "https://farm.org/q", None, "z", 1)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, n int")
    got = {r.page_id: r for r in urls.filter_urls(table).collect()}
    assert len(got) == len(rows)
    for i, (u, _) in enumerate(pages):
        host, path = host_of(u)
        rule, says = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == says
    assert got[5].verdict == got[None].verdict == "block"  # links to blocked hosts only
    assert {got[i].verdict for i in (6, 7, 8, 9, 10, 11)} == {"allow"}


def test_ranks_are_those_of_a_plain_loop(spark):
    rng = random.Random(13)
    hosts = [f"h{i}" for i in range(30)]
    edges = collections.Counter((rng.choice(hosts), rng.choice(hosts)) for _ in range(120))
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    # a chain far longer than any number of rounds between two tables, of very many links each
    edges |= {(f"c{i}", f"c{i + 1}"): 10**8 for i in range(60)}
    seeds = {h: (rng.choice([0, 0, 3]), rng.choice([0, 0, 2])) for h in hosts[:20]} | {"c0": (3, 0), "c60": (0, 2)}
    sums = [max(1, sum(s[k] for s in seeds.values())) for k in (0, 1)]
    names = sorted({*seeds, *(x for e in edges for x in e)})
    start = {h: tuple(seeds.get(h, (0, 0))[k] * urls.MASS // sums[k] for k in (0, 1)) for h in names}
    state, out, back = {h: (0, 0) for h in names}, collections.Counter(), collections.Counter()
    for (a, b), n in edges.items():
        out[a] += n
        back[b] += n
    before = None
    while state != before:
        t, d = collections.Counter(), collections.Counter()
        for (a, b), n in edges.items():
            t[b] += state[a][0] * n // out[a]
            d[a] += state[b][1] * n // back[b]
        keep = urls.OF - urls.FOLLOW
        before, state = state, {h: tuple((start[h][k] * keep + x[h] * urls.FOLLOW) // urls.OF for k, x in ((0, t), (1, d))) for h in names}
    got = urls.ranks(
        spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trusted bigint, blocked bigint"),
    )
    assert {r.host: (r.trust, r.distrust) for r in got.collect()} == state


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(none).count() == 0
    assert simhash_components(none).count() == 0 and keep_one(none).count() == 0
    assert mix(none).count() == 0 and mixed_documents(none).count() == mixed_blocks(none).count() == 0
    assert pack(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), 50).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_packed_ids_of_added_tokens_in_any_case(spark):
    """Strings of added tokens, in whatever case and company, give the ids that the library gives."""
    rng = random.Random(17)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|endoftext|", "Word", "word.", "x!!", "É!", "<|", "#a#", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    file = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    for text, ids in zip(texts, WordTokens(file).encode(texts)):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


def test_top_k_of_empty_and_huge_vectors(spark):
    rows = [(0, []), (1, []), (2, []), (50, [2.0**60, 1.0]), (51, [3.0, 2.0**55]), (52, [1.5, -0.25]), (53, [2.0**60, 2.0]), (100, [2.0, 7.0])]
    rows += [(54, [float("inf"), 1.0]), (55, None), (56, [1.0, None])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows if i in (0, 1, 2, 50, 51, 52, 53, 100)}
    want = []
    for q in (0, 50, 100):
        scores = [(sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        held = sorted((-max(-(2**63) + 1, min(2**63 - 1, s)), i) for s, i in scores)  # in the range of a long
        want += [(q, k, i, -s) for k, (s, i) in enumerate(held[:5], 1)]
    assert sorted(tuple(r) for r in top_k(table, 50).collect()) == want
