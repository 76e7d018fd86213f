"""Near-duplicates, packing, toxicity, decontamination, private values, licences: brute force and edge rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, licenses, near_dup, packing, pii, sharding, toxicity
from tabloom.llm.common import shingle_set, table
from tabloom.llm.components import components
from tabloom.llm.tokens import Encoder, default_tokenizer

DOCS = "doc_id long, text string"
LONG = "alpha beta gamma delta " * 60_000
#: Columns whose names the operators use themselves.
CLASH = ("key", "hub", "rep", "bucket", "component_id", "kept", "shard", "slot", "n_private", "length", "score", "label", "h", "record", "records", "unit", "__found", "__between", "_bad", "_dropped", "_held", "salt", "n", "r", "copy", "copies")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH) if c not in df.columns})


def edge_rows():
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, LONG), (7, LONG + "end"), (8, "Ünï çødé ẞ ﬁ ½ 𝔘 漢字 don't <|endoftext|>")]


# --- near-duplicates ----------------------------------------------------------------------------


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def corpus(seed=0, families=25, members=9):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for _ in range(families):
        base = r.choices(vocabulary, k=r.choice((3, 5, 8, 40, 120, 400)))
        for _ in range(r.randint(1, members)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 6, 12))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w).title() if r.random() < 0.2 else " ".join(w)))
            i += r.randint(1, 5)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rows = corpus(percent)
    want, sizes = brute_components(rows, percent)
    got = near_dup.near_duplicates(docs(spark, rows).repartition(5), percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group of near copies is compared in blocks and comes out the same."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice((2, 3, 5, 7))):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want, _ = brute_components(rows, 85)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    got = near_dup.near_duplicates(docs(spark, rows), 85).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_near_duplicates_of_a_large_group_that_drifts(spark, monkeypatch):
    """Members that link with one another, but not with the smallest of their group, find each other."""
    r = random.Random(9)
    base, rows, i = [f"b{i}" for i in range(300)], [], 0
    for step in range(12):  # each base is a little further from the first
        for at in range(step * 12, step * 12 + 12):
            base[at] = f"c{step}-{at}"
        for _ in range(12):
            w = list(base)
            w[r.randrange(200, 300)] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    want, _ = brute_components(rows, 85)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 10)
    got = near_dup.near_duplicates(docs(spark, rows), 85).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(clashing(docs(spark, edge_rows()))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got) == len(edge_rows())
    assert by[1] == by[2] == [(0, 1, True)] or (by[1], by[2], by[3]) == ([(0, 1, True)], [(0, 2, True)], [(0, 3, True)])
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2 and by[None] == [(1, None, True)]
    assert by[7][0][1] == 6
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dup.keep_one(docs(spark, [])).columns == ["doc_id", "text"]


def test_scheme_guarantees_and_misses():
    s = near_dup.scheme_for(85)
    assert s.miss <= 1e-5 and s.sure_distance == 2 * s.chunks - 1
    rng = np.random.default_rng(1)
    import pyarrow as pa

    a = rng.integers(0, 2**16, s.symbols, dtype=np.uint16)
    for _ in range(50):  # any pair up to the sure distance shares a key
        b = a.copy()
        at = rng.choice(s.symbols, s.sure_distance, replace=False)
        b[at] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], ["rep", "sig"])
        keys = [k.column("key").to_pylist() for k in near_dup._keys(iter([batch]), s)]
        assert any(x == y for x, y in keys)
    with pytest.raises(ValueError):
        near_dup.scheme_for(20)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles_follow_ascii_white_space():
    assert len(shingle_set("a b c d e f".encode())) == 2
    assert len(shingle_set("a b c d e".encode())) == 1  # no-break space is no white space here
    assert (shingle_set(b"A B C D E") == shingle_set(b"a b c d e")).all()
    assert len(shingle_set(None)) == len(shingle_set(b" \n")) == 0


# --- tokens and packing -------------------------------------------------------------------------

ENC = Encoder(default_tokenizer())
ODD = st.text(alphabet=st.sampled_from(list("abAB ßÄéñÿ×÷'.,!%09 \n\t\r-_|<>½²İıſ漢字🙂́ \x1c\x85")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_tokens_equal_the_tokenizer(texts):
    texts = [*texts, "don't I'll <|endoftext|> x<|startoftext|>y", None, ""]
    for t, ids in zip(texts, ENC.encode(texts), strict=True):
        assert ids.tolist() == ENC.tok.encode(t or "", add_special_tokens=False).ids


def test_tokens_of_the_corpus(spark, sf):
    texts = [r["text"] for r in table(spark, sf, "documents").collect()]
    small = Encoder(default_tokenizer())
    small.bound = 500  # forgets again and again
    for lo in range(0, len(texts), 40):
        for t, ids in zip(texts[lo : lo + 40], small.encode(texts[lo : lo + 40]), strict=True):
            assert ids.tolist() == ENC.tok.encode(t, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_fill_is_the_best_sum(counts, capacity):
    taken = packing.fill(dict(counts), capacity)
    assert all(0 < c <= counts[x] for x, c in taken.items())
    sums = {0}
    for x, c in counts.items():
        sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= capacity}
    assert sum(x * c for x, c in taken.items()) == max(sums)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack_lengths_places_all_once(lengths):
    rows = packing.pack_lengths(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 64 for r in rows)


def check_pack(rows, got, size):
    want = {}
    for i, t in rows:
        ids = np.array([*ENC.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append([(k, len(ids[k : k + size]), zlib.crc32(ids[k : k + size].tobytes()), len(ids)) for k in range(0, len(ids), size)])
    assert {i: sorted(p for d in v for p in d) for i, v in want.items()} == {i: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i) for i in want}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_pack_edges_and_ids(spark):
    rows = edge_rows()
    check_pack(rows, packing.pack(clashing(docs(spark, rows))).collect(), 4096)
    assert packing.pack(docs(spark, [])).count() == 0
    with_ids = packing.pack(docs(spark, rows), length=16, with_ids=True)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids.limit(500).collect())
    plain = packing.pack(docs(spark, rows), length=16)
    assert with_ids.drop("ids").columns == plain.columns and with_ids.count() == plain.count()
    assert with_ids.where(F.size("ids") != F.col("length")).count() == 0


def test_pieces_with_one_crc_keep_their_own_ids(spark, monkeypatch):
    rows = [(7, "river stone cloud"), (7, "maple tower quiet"), (7, "lantern copper bridge")]
    want = sorted(tuple(r["ids"]) for r in packing.pack(docs(spark, rows), with_ids=True).collect())
    made = packing._pieces

    def one_crc(batches, **how):
        for batch in made(batches, **how):
            at = batch.schema.get_field_index("ids_crc32")
            yield batch.set_column(at, "ids_crc32", pa.array([0] * batch.num_rows, pa.int64()))

    monkeypatch.setattr(packing, "_pieces", one_crc)
    got = packing.pack(docs(spark, rows), with_ids=True).collect()
    assert sorted(tuple(r["ids"]) for r in got) == want and len(set(want)) == 3


def test_pack_wastes_little(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    sequences = check_pack(rows, packing.pack(docs(spark, rows)).collect(), 4096)
    used = sum(n for p in sequences.values() for _, n in p)
    assert used / (4096 * len(sequences)) > 0.98


# --- toxicity -----------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = toxicity.toxicity(d, labels)
    assert out.count() == d.count()
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic", F.crc32(F.col("doc_id").cast("string")).alias("crc")).collect()
    assert rows and all(r["crc"] % 5 == 0 and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    bad, good = ([r["score"] for r in rows if r["toxic"] == x] for x in (1, 0))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.85
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.05
    kept = toxicity.keep_clean(d, labels)
    assert kept.columns == d.columns and 0.75 * d.count() < kept.count() < d.count()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    train = [(i, f"you {'idiot' if i % 2 else 'friend'} are here number {i}") for i in range(1, 60)]
    rows = [*[(i + 1000, t) for i, t in edge_rows() if i], (None, "x"), *train]
    out = toxicity.toxicity(clashing(docs(spark, rows)), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    none = toxicity.toxicity(docs(spark, [(1, "a")]), labels.where("false")).collect()
    assert [(r["score"], r["predicted"]) for r in none] == [(0.0, 0)]
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark, [(3, "a"), (4, None)]), odd).count() == 2


def plain_features(text, learned):
    """The features of one text, word by word."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, length = len(words), len(text)
    bare = [w.strip(toxicity._EDGE) for w in text.lower().split()]
    hits, other, hidden, odd, stretched, you = [], [], 0, 0, 0, []
    for i, w in enumerate(bare):
        if w in toxicity.SEED_LEXICON:
            hits.append(i)
        elif w in learned:
            other.append(i)
        elif w in toxicity.SECOND_PERSON:
            you.append(i)
        elif not w.isalpha() and w:
            odd += 1
            plain = "".join(toxicity._LETTERS.findall(w.translate(toxicity._LEET)))
            if plain in toxicity.SEED_LEXICON or plain in learned:
                hidden += 1
                hits.append(i)
        elif len(w) > 3 and toxicity._STRETCHED.search(w):
            stretched += 1
            if toxicity._STRETCHED.sub(r"\1", w) in toxicity.SEED_LEXICON | learned:
                hidden += 1
                hits.append(i)
    near = 0
    if (hits or other) and you:
        at, where = np.array(sorted(hits + other)), np.array(you)
        k = np.searchsorted(where, at - toxicity.NEAR)
        near = int(((k < len(where)) & (where[np.minimum(k, len(where) - 1)] <= at + toxicity.NEAR)).sum())
    letters = sum(map(str.isupper, text))
    marks = text.count("!") + text.count("?")
    known = sum(bare[i] in toxicity.SEED_LEXICON for i in hits)
    return [100 * len(hits) / n, float(np.log1p(len(hits))), 100 * (known + len(other)) / n, float(np.log1p(known + len(other))), 100 * hidden / n, 100 * near / n, 100 * len(you) / n, letters / length, marks / length, odd / n, stretched / n, float(np.log1p(n)), len(set(bare)) / n]


def test_toxicity_features(spark, sf):
    kinds = toxicity._Kinds(frozenset(("wretch", "naff")))
    f = dict(zip(toxicity.FEATURES, toxicity.features(["You are an 1d10t and a looooser, moron!"], kinds)[0], strict=True))
    assert f["lexicon_log"] > 0 and f["hidden"] > 0 and f["near_you"] > 0 and f["marks"] > 0
    assert not toxicity.features([None, " ", ""], kinds).any() and toxicity.features([], kinds).shape == (0, len(toxicity.FEATURES))
    texts = [None, "", " \n", "You", "idiot", "you " * 3 + "x " * 9 + "fool", "fool", "you", "n4ff wr3tch !!! ??", "you naff naaaff wreeetch", "Loooooser ÉTÉ Straße"]
    texts += [r["text"] for r in table(spark, sf, "documents").select("text").collect()]
    got = toxicity.features(texts, kinds)
    assert np.allclose(got, [plain_features(x, kinds.learned) for x in texts], rtol=0, atol=1e-12)
    kinds.bound = 5  # words are forgotten and learned again
    assert np.array_equal(got, np.concatenate([toxicity.features(texts[lo : lo + 7], kinds) for lo in range(0, len(texts), 7)]))


# --- decontamination ----------------------------------------------------------------------------


def test_leaks_against_shared_runs(spark, sf):
    """On the corpus: every document that shares a run of 11 plain words with an item is found, and few others."""
    d, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, items).collect()}
    plain = lambda t: re.findall(r"\w+", t.lower())
    grams = {n: {} for n in (8, 14)}
    for r in items.collect():
        w = plain(r["text"])
        for n, g in grams.items():
            for k in range(len(w) - n + 1):
                g.setdefault(tuple(w[k : k + n]), set()).add(r["item_id"])
    sure, may = set(), set()
    for r in d.collect():
        w = plain(r["text"])
        for n, out in ((14, sure), (8, may)):
            for k in range(len(w) - n + 1):
                out |= {(r["doc_id"], i) for i in grams[n].get(tuple(w[k : k + n]), ())}
    assert sure and sure <= got <= may


ITEM = "A train leaves at 30 km per hour from Anna to the big house and returns with 12 apples and 30 bags of corn for the market."


def test_leaks_reparameterised_and_inconsistent(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, "")], "item_id long, text string")
    other = ITEM.replace("30", "45").replace("Anna", "Berta").replace("12", "7")
    rows = [(1, "Well then. " + other), (2, other.replace("45 bags", "46 bags")), (3, "xx " + ITEM + " yy"), (4, "nothing of the kind at all is here to be found by it"), (5, ITEM), (5, ITEM), (None, ITEM), (6, None), (7, ""), (8, LONG + ITEM)]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.leaks(clashing(docs(spark, rows)), items).collect()}
    assert got == {(1, 1): True, (3, 1): False, (5, 1): False, (8, 1): False}
    left = decontaminate.clean(docs(spark, rows), items)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "4", "6", "7", "None"]
    assert decontaminate.leaks(docs(spark, []), items).count() == 0
    assert decontaminate.leaks(docs(spark, rows), items.where("false")).count() == 0


def test_leaks_of_short_items_wherever_they_stand(spark):
    item = "which gas do green plants take in by day"
    rows = [(i, "so " * i + item + " and more") for i in range(9)] + [(9, "which gas do green plants give off by day")]
    items = spark.createDataFrame([(1, item), (2, ITEM)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs(spark, rows), items).collect()} == set(range(9))


def test_leaks_of_items_full_of_slots(spark):
    """Wherever they stand: slot-dense, windows with too few literals in between, almost only numbers, very short."""
    asked = {
        1: "What is 15 percent of 240 plus 30 percent of 90 minus 12?",
        2: "Compute 12 + 7 * 3 - 4 / 2 + 9 * 5 - 1",
        3: "Tom has 3 kg of apples and Ann has 5 kg of pears",
        4: "Name the largest moon of Saturn",
    }
    items = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    rows = [(10 * n + i, "so " * i + "we ask: " + text.lower() + " and then some more of it") for n, text in asked.items() for i in range(8)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), items.withColumn("text", F.lower("text"))).collect()}
    assert got == {(10 * n + i, n) for n in asked for i in range(8)}
    other = asked[3].replace("3", "8").replace("Ann", "Eve").replace("5", "6"), asked[1].replace("240", "250").replace("90", "80")
    rows = [(10 * k + i, "so " * i + text + ". And so on.") for k, text in enumerate(other) for i in range(8)]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame([(1, "So " + asked[3]), (2, "So " + asked[1])], "item_id long, text string")).collect()}
    assert {(d, n) for d, n, again in got if again} >= {(10 * k + i, k + 1) for k in range(2) for i in range(1, 8)}


def test_stock_phrases_are_no_leaks(spark):
    """A shared phrase of 8 to 12 words drops no document, a run of 13 or most of the item does, at any offset."""
    stock = "which of the following is the best answer to this question here"
    item = stock + " about how green plants make sugar out of light and water"
    most = item.replace("answer", "reply").replace("light", "air")  # 12 words in a row, 21 of 23
    texts = {0: stock + " on old ships", 1: stock + " about how we sail", 2: item, 3: most}
    rows = [(10 * k + i, "so " * i + text + " and so on") for k, text in texts.items() for i in range(5)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["n_windows"] for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert set(got) == {10 * k + i for k in (1, 2, 3) for i in range(5)}
    assert {got[20 + i] for i in range(5)} == {len(item.split()) - 7}
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), items).collect()} == set(range(5))


def brute_tokens(text):
    """(template token, word) by plain rules: units after numbers, capitals inside a sentence as names."""
    units, out, last = set(decontaminate.UNITS.split()), [], ""
    for m in re.finditer(r"[^\W_]+", text):
        raw, before = m[0], text[max(0, m.start() - 2) : m.start()]
        glued = re.fullmatch(r"(\d+)([^\W\d_]+)", raw)
        if glued and glued[2].lower() in units:
            out += [(decontaminate.NUMBER, glued[1]), (decontaminate.UNIT, glued[2].lower())]
        elif raw.isdigit():
            out.append((decontaminate.NUMBER, raw))
        elif raw.lower() in units and last.isdigit() and len(before.strip()) <= 1 and text[m.start() - 1] == " " and text[m.start() - 2].isdigit():
            out.append((decontaminate.UNIT, raw.lower()))
        elif raw[0].isupper() and len(before) == 2 and before[1] == " " and (before[0].islower() or before[0].isdigit() or before[0] in ",;"):
            out.append((decontaminate.NAME, raw.lower()))
        else:
            out.append((raw.lower(), raw.lower()))
        last = raw
    return out


def brute_leaks(docs_, items_):
    """All pairs, all alignments, whole items."""
    found = {}
    for d, text in docs_:
        ours = brute_tokens(text)
        for i, asked in items_:
            theirs = brute_tokens(asked)
            need = min(13, len(theirs))
            for shift in range(-len(theirs) + 1, len(ours)):
                z = [(theirs[k], ours[k + shift]) for k in range(max(0, -shift), min(len(theirs), len(ours) - shift))]
                same = [a[1] == b[1] for a, b in z]
                agree = [a[0] == b[0] or a[1] == b[1] for a, b in z]
                slots = {decontaminate.NAME, decontaminate.UNIT, decontaminate.NUMBER}

                def ok(part):
                    pairs = {(a, b) for a, b in part if a[0] == b[0] and a[0] in slots}
                    words = sum(not (a[0] == b[0] and a[0] in slots) for a, b in part)
                    return words >= 5 and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)

                def runs(flags):
                    lo = 0
                    for k, f in enumerate([*flags, False]):
                        if not f:
                            yield lo, k
                            lo = k + 1

                like = any(b - a >= need and ok(z[a:b]) for a, b in runs(agree))
                share = [p for p, f in zip(z, agree, strict=True) if f]
                # an alignment is met by a key: eight agreeing tokens in a row, or all of a short item
                key = any(b - a >= min(8, len(theirs)) for a, b in runs(agree))
                if like or (key and len(share) >= 0.8 * len(theirs) and ok(share)) or any(b - a >= need for a, b in runs(same)):
                    found[(d, i)] = True
    return set(found)


def test_leaks_against_all_alignments(spark):
    """Copies, other values, other case, cuts at all lengths, at any offset: as a plain comparison of all alignments."""
    r = random.Random(6)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    items_, docs_ = [], []
    for i in range(30):
        w = r.choices(words, k=r.randint(9, 30))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(1, len(w))] = r.choice(("Anna", "17", "30 kg", "5", "Bob"))
        items_.append((i, " ".join(w) + "."))
    for d in range(240):
        i, text = r.choice(items_)
        w = text.rstrip(".").split(" ")
        kind = d % 6
        if kind == 1:
            w = [{"17": "23", "30": "45", "5": "9", "Anna": "Carl", "Bob": "Dora"}.get(x, x) for x in w]
        elif kind == 2:
            w = [x.lower() for x in w] if d % 12 == 2 else [x.upper() for x in w]
        elif kind == 3:
            lo = r.randrange(len(w))
            w = w[lo : lo + r.randint(6, 20)]
        elif kind == 4:
            w[r.randrange(len(w))] = "other"
            w[r.randrange(len(w))] = "another"
        elif kind == 5:
            w = r.choices(words, k=20)
        docs_.append((d, " ".join([*r.choices(words, k=r.randint(0, 9)), *w, *r.choices(words, k=3)])))
    want = brute_leaks(docs_, items_)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs(spark, docs_), spark.createDataFrame(items_, "item_id long, text string")).collect()}
    assert 100 < len(want) < 240 and got == want


def test_leaks_do_not_depend_on_other_items_or_case(spark):
    run = "river stone cloud seven maple tower quiet window garden lantern copper bridge feather"
    dense = "What is 3 x 4 + 5 x 6 - 7 x 8 + 9 x 10 - 11 x 12 ?"
    named = "In spring Anna and Bob walk from Berlin to the old mill and count all of the birds"
    items = [(1, run + " and more words that no document has"), (2, dense), (3, named)]
    rows = [(i, "so " * i + run + " then it ends") for i in range(8)] + [(20, "so we ask: " + dense), (21, dense.upper()), (30, named.lower()), (31, named.upper()), (32, named.replace("Anna", "Eva"))]
    want = {(i, 1) for i in range(8)} | {(20, 2), (21, 2), (30, 3), (31, 3), (32, 3)}
    for more in ([], [(9, "eight little tokens that stand for no one")], [(9, "word")]):
        got = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items + more, "item_id long, text string")).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert {x["doc_id"]: x["reparameterised"] for x in got if x["item_id"] == 3} == {30: False, 31: False, 32: True}


def test_leaks_by_shuffle_join_are_the_same(spark, sf, monkeypatch):
    d, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    one = {tuple(r) for r in decontaminate.leaks(d, items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    for hot, words in ((20, 1 << 20), (10_000, 7)):  # some keys hot and a sparse sieve; all keys hot and a full one
        monkeypatch.setattr(decontaminate, "MOST_HOT", hot)
        monkeypatch.setattr(decontaminate, "SIEVE_WORDS", words)
        assert {tuple(r) for r in decontaminate.leaks(d, items).collect()} == one


def test_sieve_keeps_all_windows_of_items(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    there = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("at"), F.xxhash64("id").alias("h"))
    kept = {r["doc_id"] for r in decontaminate._sieved(there, keys).collect()}
    assert set(range(500)) <= kept and len(kept) < 520
    assert decontaminate._sieved(there, keys.limit(0)).count() == 0


def test_hot_windows_are_dealt_to_many_parts(spark):
    keys = spark.createDataFrame([(h, i) for h in (1, 2) for i in range(3)], "h long, item_id long")
    there = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("at"), F.when(F.col("id") < 2_900, F.lit(1)).otherwise(F.col("id")).cast("long").alias("h"))
    met = decontaminate._met_by_shuffle(there, keys)
    assert met.count() == 2_900 * 3
    assert "salt" in met._jdf.queryExecution().optimizedPlan().toString()


# --- private values -----------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(reversed(d))) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


CASES = [
    ("card 4845168114407329.", lambda t: luhn(t[5:21]) and t[5:21].isdigit()),
    ("card 4845-1681-1440-7329", lambda t: luhn(t[5:]) and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", t[5:])),
    ("iban DE89370400440532013000", lambda t: mod97(t[5:]) == 1 and t[5:7] == "DE"),
    ("iban GB82 WEST 1234 5698 7654 32", lambda t: mod97(t[5:]) == 1 and "WEST" in t),
    ("at 97.51.17.173, then", lambda t: all(int(x) < 256 for x in t[3:].split(",")[0].split("."))),
    ("call +1 (017) 555-7713 now", lambda t: re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", t)),
    ("ssn 123-45-6789", lambda t: re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", t)),
    ("on 1999-12-31 or 31.12.1999", lambda t: re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d) or \3\.\2\.\1", t)),
    ("über und.34@mail7.example.com!", lambda t: "mail7" not in t and "und.34" not in t and t.endswith("!")),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', lambda t: re.fullmatch(r'token = "[0-9a-f]{40}" x', t)),
]
LEFT = ["card 9807915762804491", "999.1.1.1", "666-12-3456", "1999-02-30", "Version 2.0 of 12", "DE88370400440532013000", "CC BY-NC 4.0.", "a@b", "", None, "x\x01y 12"]


def test_private_values(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(LEFT)]
    out = {r["doc_id"]: r for r in pii.pseudonymise(clashing(docs(spark, rows)), "k").collect()}
    for i, (t, ok) in enumerate(CASES):
        assert out[i]["text"] != t and ok(out[i]["text"]) and out[i]["n_private"] >= 1, out[i]
    for i, t in enumerate(LEFT):
        assert out[100 + i]["text"] == t and out[100 + i]["n_private"] == 0
    same = re.sub(r"\D", "", out[0]["text"])
    assert re.sub(r"\D", "", out[1]["text"]) == same  # equal values stay linked, in any format
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(spark, rows), "another").collect()}
    assert other[0] != out[0]["text"]


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = df.select(pii.permute_digits(F.col("d"), "k", "x").alias("p")).collect()
    assert sorted(r["p"] for r in got) == [f"{i:03d}" for i in range(1000)]
    pairs = spark.range(189 * 7).select(pii.feistel(F.col("id") % 189, F.floor(F.col("id") / 189), F.lit(189), F.lit(7), "k", "d").alias("p"))
    assert pairs.distinct().count() == 189 * 7


def test_private_values_in_long_texts_and_gaps(spark):
    filler = "wörd 12 a|b (x) 3.5 " * 5000
    text = f"4845168114407329{filler}x@y.org {filler}4845168114407329"
    out = pii.pseudonymise(docs(spark, [(1, text), (2, LONG)]), "k").orderBy("doc_id").collect()
    parts = out[0]["text"].split(filler)
    assert len(parts) == 3 and out[0]["n_private"] == 2 and luhn(parts[2]) and out[1]["text"] == LONG
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


MORE_CASES = [
    ("call +4930123456789 now", lambda t: re.fullmatch(r"call \+49\d{11} now", t)),
    ("ruf 0171 2345678 an", lambda t: re.fullmatch(r"ruf \d{4} \d{7} an", t)),
    ("password: hunter2secret.", lambda t: "hunter" not in t and t.endswith(".") and len(t) == 24),
    ("iban de89370400440532013000", lambda t: mod97(t[5:].upper()) == 1 and t[5:7] == "de"),
    ("at 2001:db8:85a3:0:0:8a2e:370:7334 now", lambda t: re.fullmatch(r"at 2001(:[0-9a-f]{1,4}){7} now", t)),
    ("k " + "ab12" * 35, lambda t: re.fullmatch("k [0-9a-f]{140}", t)),
    ("x" * 80 + "@x.org", lambda t: "x@" not in t),
    ('token="4845168114407328"', lambda t: re.fullmatch(r'token="[0-9a-f]{16}"', t)),
]
MORE_LEFT = ["commit " + "a1" * 20, "a1b2" * 10, "sha256: " + "ab" * 32, "std::vector a::b", "0997523947200289", "the token: a thing", "12:30 or 1:2"]


def test_private_values_of_more_forms(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MORE_CASES)] + [(100 + i, t) for i, t in enumerate(MORE_LEFT)]
    mixed = clashing(docs(spark, rows))
    made = pii.pseudonymise(mixed, "k-that-must-not-show")
    assert made.columns == mixed.columns
    out = {r["doc_id"]: r for r in made.collect()}
    assert all(out[0][c] == r for c, r in zip(("__found", "__between"), mixed.select("__found", "__between").first(), strict=True))
    for i, (t, ok) in enumerate(MORE_CASES):
        assert out[i]["text"] != t and ok(out[i]["text"]) and out[i]["n_private"] == 1, out[i]
    for i, t in enumerate(MORE_LEFT):
        assert out[100 + i]["text"] == t and out[100 + i]["n_private"] == 0, out[100 + i]
    assert "must-not-show" not in made._jdf.queryExecution().toString()


def test_dates_stay_distinct(spark):
    """All dates of 30 years in each form: distinct before, distinct after, in the same form."""
    day = F.explode(F.sequence(F.to_date(F.lit("1990-01-01")), F.to_date(F.lit("2019-12-31")))).alias("d")
    forms = [F.date_format("d", f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")]
    old = spark.range(1).select(day).select(F.explode(F.array(*forms)).alias("old")).distinct()
    got = pii.pseudonymise(old.withColumn("text", F.col("old")), "k").collect()
    shape = lambda t: re.sub(r"\d", "9", t) + ("m" if t[2] == "/" and int(t[3:5]) > 12 else "")
    assert len({r["text"] for r in got}) == len(got) and all(shape(r["text"]) == shape(r["old"]) and r["n_private"] == 1 for r in got)


# --- licences and shards ------------------------------------------------------------------------


def test_license_forms(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    full = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    rows = [
        (1, "Copyright (c) 2020 Me\n" + full.upper().replace("'", "")),
        (2, "some text\nreleased under the MIT Licence!!\nmore"),
        (3, mit),
        (4, "licensed under the Apache License, Version 2.1."),
        (5, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0.\nLicensed  under cc by nc 4.0"),
        *[(i + 10 if i else None, t) for i, t in edge_rows()],
        (6, LONG + "\nReleased under the MIT License."),
        (2, "again"),
    ]
    got = {(r["doc_id"], r["license"]): (r["whole"], r["n_units"]) for r in licenses.scan(clashing(docs(spark, rows))).collect()}
    assert set(got) == {(1, "BSD-3-Clause"), (2, "MIT"), (3, "MIT"), (5, "CC-BY-NC-4.0"), (6, "MIT")}
    assert got[(1, "BSD-3-Clause")] == (True, 1) and got[(2, "MIT")] == (False, 1) and not got[(5, "CC-BY-NC-4.0")][0]
    assert licenses.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, []), (("x", "no sign of it"),))


def test_whole_licences_in_other_forms(spark):
    """Entire texts, wrapped anew, with other case, punctuation, years and spellings, are whole; changed ones are not."""
    import textwrap

    first = {}
    for name, text in licenses.KNOWN:
        first.setdefault(name, text)
    names = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "MIT-0")
    rows, want = [], {}
    for i, name in enumerate(names):
        longest = max((t for n, t in licenses.KNOWN if n == name), key=len)
        paragraphs = longest.split("\n\n")
        short = "\n\n".join("\n".join(textwrap.wrap(p, 50)) if "opyright (" not in p else p for p in paragraphs)
        other = re.sub(r"\blicense\b", "licence", longest.upper().lower()).replace('"', "''").replace("http:", "https:")
        forms = [longest, "Copyright (c) 2031, Someone Else\nAll rights reserved.\n\n" + other, short, longest.upper().replace(",", " ,")]
        for k, text in enumerate(forms):
            rows.append((10 * i + k, text))
            want[10 * i + k] = name
        rows.append((10 * i + 9, longest + "\nand one word more"))
    got = {}
    for r in licenses.scan(docs(spark, rows)).where("whole").collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(got.get(d) == {name} for d, name in want.items()), {d: (name, got.get(d)) for d, name in want.items() if got.get(d) != {name}}
    assert not any(d % 10 == 9 for d in got)
    table_ = spark.createDataFrame([("Own", "You have permission to read this text.")], "license string, text string")
    assert [tuple(r) for r in licenses.scan(docs(spark, [(1, "you have Permission: to read -- this text")]), table_).collect()] == [(1, "Own", True, 1)]


def test_shards_hold_all_rows_evenly(spark, sf, tmp_path):
    d = table(spark, sf, "documents")
    out = sharding.shard(d.select("doc_id", "text", "lang"), bucket_bytes=40_000)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in d.collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3
    other = {r["doc_id"]: r["shard"] for r in sharding.shard(d.select("doc_id", "text"), seed=5).collect()}
    assert other != {r["doc_id"]: r["shard"] for r in rows}
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_shard_spreads_a_hot_id(spark):
    rows = [(None if i % 2 else 7, f"text {i}") for i in range(400)]
    out = sharding.shard(docs(spark, rows).repartition(3), shards=4, bucket_bytes=500)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert [(r["n"], r["last"]) for r in got] == [(100, 99)] * 4
    assert sorted(r["text"] for r in out.collect()) == sorted(t for _, t in rows)


def test_shard_edges(spark):
    rows = edge_rows()
    out = sharding.shard(clashing(docs(spark, rows)), shards=3)
    got = out.collect()
    assert len(got) == len(rows) and {"key", "hub", "record"} <= set(out.columns)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert sharding.shard(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs(spark, []), shards=0)


def _xxh(seed, *cells):
    """Spark's xxhash64: each cell hashed with the hash so far as its seed; nulls change nothing."""
    import xxhash

    h = seed
    for c in cells:
        if isinstance(c, (bool, np.int32)):
            h = xxhash.xxh64_intdigest(int(c).to_bytes(4, "little", signed=True), h)
        elif isinstance(c, int):
            h = xxhash.xxh64_intdigest(c.to_bytes(8, "little", signed=True), h)
        elif c is not None:
            h = xxhash.xxh64_intdigest(c.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def brute_shards(rows, shards, seed, bucket_rows, bucket_bytes):
    """(row, shard, slot) by a plain two-pass shuffle of (doc_id, text) rows."""
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    n = max(total // bucket_bytes, len(rows) // bucket_rows) + 1
    buckets, seen = {}, {}
    for row in rows:
        h = tuple(_xxh(42, np.int32(i), row[0], row[0] is None, row[1], row[1] is None) for i in (1, 2))
        copy = seen[h] = seen.get(h, -1) + 1
        buckets.setdefault(_xxh(42, *h, copy, np.int32(seed)) % n, []).append((*h, copy, row))
    order = []
    for b in sorted(buckets):
        x = sorted(buckets[b], key=lambda r: r[:3])
        for i in range(len(x) - 1, 0, -1):
            j = _xxh(42, np.int32(seed), b, np.int32(i)) % (i + 1)
            x[i], x[j] = x[j], x[i]
        order += [r[3] for r in x]
    return sorted((str(r), k % shards, k // shards) for k, r in enumerate(order))


def test_shards_against_a_plain_shuffle(spark, sf):
    """The places are those of a plain Fisher-Yates shuffle in buckets, under any partitions, with copies and nulls."""
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + [(None, ""), (None, None), (7, "same")] * 40
    want = brute_shards(rows, 5, 11, 50, 1 << 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, parts in ((4, 1), (16, 7), (211, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = sharding.shard(docs(spark, rows).repartition(parts), 5, 11, bucket_rows=50, bucket_bytes=1 << 20).collect()
            assert sorted((str((r["doc_id"], r["text"])), r["shard"], r["slot"]) for r in out) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shards_of_one_repeated_row(spark, monkeypatch):
    """Copies beyond what one task deals, with columns that no hash takes."""
    monkeypatch.setattr(sharding, "DEALT_AT_ONCE", 30)
    d = docs(spark, [(1, "copy")] * 200 + [(2, "other")]).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sharding.shard(d, 3, bucket_rows=20).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((k % 3, k // 3) for k in range(201))
    assert sum(r["text"] == "copy" for r in got) == 200 and got[0]["m"] == {"k": 1}


def test_sharding_query_digests(spark, sf):
    from tabloom.llm import queries

    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = queries.QUERIES["op8_sharding"](spark, sf).collect()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    want = brute_shards(rows, 16, sharding.SEED, sharding.BUCKET_ROWS, sharding.BUCKET_BYTES)
    assert sorted((str((r["doc_id"], next(t for i, t in rows if i == r["doc_id"]))), r["shard"], r["slot"]) for r in got) == want
