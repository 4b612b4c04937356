"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from paperloom.llm import byte_bpe, chat_format, components, line_dedup, lm_scoring, media_columns, ngram_join, packing, quality_classifier, quality_rules, token_counts
from paperloom.llm.encoding import SpacedEncoder
from paperloom.llm.registry import QUERIES
from pyspark.sql import functions as F

SMALL, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, votes string, component string"


def word(r):
    return "".join(r.choices("abcdeé", k=r.randint(1, 7)))


def texts():
    """Copies, near copies, shared passages and the odd cases."""
    r = random.Random(5)
    out = [None, "", "   \n\t ", "one", "ONE", "a b c d e", "A  b\nC d e", "<|endoftext|> x<|endoftext|>", "日本語のテキスト 한국어 🎉", "x" * 3000, "\x1c a\x1fb\x85c　d", "a|b # $ %"]
    base = [" ".join(word(r) for _ in range(80)) for _ in range(6)]
    passage = " ".join(word(r) for _ in range(30))
    for b in base:
        words = b.split()
        for _ in range(6):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = word(r)
            out.append(" ".join(w))
        out.append(b + "\n" + passage)
        out.append(b)
    out.append(" ".join(word(r) for _ in range(9000)))
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t) for i, t in enumerate(texts())]
    return [*found, (3, "one"), (None, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    order = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


def test_ngram_join(docs, rows, empty):
    same(ngram_join.ngram_jaccard_join(docs).collect(), brute.jaccard_components(rows))
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_ngram_join_parts(docs, rows, monkeypatch):
    """Families dealt over pairs of parts give the same components."""
    monkeypatch.setattr(ngram_join, "FAMILY", 3)
    same(ngram_join.ngram_jaccard_join(docs).collect(), brute.jaccard_components(rows))


def test_ngram_join_on_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    same(QUERIES["op1_ngram_join"](spark, SMALL).collect(), brute.jaccard_components([tuple(r) for r in d.select("doc_id", "text").collect()]))


def test_one_row_of_each_group_stays(spark):
    """Rows with one doc_id but different texts both stay; of equal and near ones the lowest doc_id does."""
    r = random.Random(3)
    base = [word(r) for _ in range(200)]
    near = " ".join([*base[:100], "other", *base[101:]])
    rows = [(5, " ".join(base), 1), (3, near, 2), (5, " ".join(base), 3), (None, near, 4), (7, "its own text, quite short", 5), (7, "another text of row seven", 6), (8, None, 7), (8, "", 8)]
    out = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(2))
    assert sorted(x.component_id for x in out.collect()) == [2, 5, 6, 7, 8] and out.columns == ["doc_id", "text", "component_id"]
    assert ngram_join.without_near_copies(out.limit(0)).count() == 0


def test_signature_tree_bounds():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 48, 40, dtype=np.uint64)) for _ in range(30)]
    sets += [np.sort(np.r_[s[:-3], r.integers(0, 1 << 48, 3, dtype=np.uint64)]) for s in sets for _ in range(5)]
    tree = ngram_join.SignatureTree(np.array(list(map(len, sets))), sets, np.zeros(len(sets), int))
    links = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert brute.union_find(len(sets), links) == brute.union_find(len(sets), tree.links())


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3), *[(100 + i, 101 + i) for i in range(30)], *[(200, 201 + i) for i in range(50)]]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = brute.union_find(300, [(a, b) for a, b in edges if a is not None])
    assert got == {n: want[n] for e in edges if e[0] is not None for n in e}


def test_components_by_runs_and_rounds(spark, monkeypatch):
    """Edges that one run held are written once; those of several runs give the same after rounds."""
    r, wrote = random.Random(3), []
    edges = [(r.randrange(1 << 40), r.randrange(1 << 40)) for _ in range(50)]
    edges += [(i, i + 1) for i in range(400)] + [(e, r.choice(edges)[1]) for e, _ in edges[:30]] + [(7, 7), (-5, -5)]
    nodes = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    want = {n: nodes[i] for n, i in zip(nodes, brute.union_find(len(nodes), [(at[a], at[b]) for a, b in edges]), strict=True)}
    monkeypatch.setattr(components, "materialize", lambda d, name, f=components.materialize: wrote.append(name) or f(d, name))
    data = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, components.connected_components(data.coalesce(1)).collect())) == want and wrote == ["components"]
    u, v = (np.array(x) for x in zip(*edges, strict=True))
    assert dict(zip(*(x.tolist() for x in components.stars(u, v)), strict=True)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.connected_components(data.repartition(7)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) and dict(map(tuple, got)) == want and wrote.count("edges") > 1


def plain_shingles(line):
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def plain_norm(line):
    return line.strip(" \t\r\x0b\f").lower()


def plain_line_links(lines):
    """All pairs of distinct lines with a Jaccard of 3/4, through shared shingles."""
    sets, holders, common = [plain_shingles(x) for x in lines], collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        # Of two sets that link, the rarest quarter (and one) of either meets the other.
        rare = sorted(s, key=lambda g: (len(holders[g]), g))[: len(s) - -(-3 * len(s) // 4) + 1]
        common.update((j, i) for j in {j for g in rare for j in holders[g]} if j != i)
    return [(a, b) for a, b in common if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]


def brute_lines(rows):
    """The place of the first line of each line's component, by (row, line number)."""
    places = collections.defaultdict(list)
    for k, (doc, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if plain_norm(line):
                places[plain_norm(line)].append((doc is None, doc if doc is not None else 0, k, n))
    keys = list(places)
    comp = brute.union_find(len(keys), plain_line_links(keys))
    first = {}
    for k, c in zip(keys, comp, strict=True):
        first[c] = min([*places[k], *([first[c]] if c in first else [])])
    return {(p[2], p[3]): (first[c][2:], p == first[c]) for k, c in zip(keys, comp, strict=True) for p in places[k]}


def spark_lines(spark, rows):
    """The same by the operator, for rows without repeated (doc_id, line number)."""
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("component is not null").collect()
    place = {doc: k for k, (doc, _) in enumerate(rows)}
    stays = {r.component: (place[r.doc_id], r.line_no) for r in found if r.kept}
    return {(place[r.doc_id], r.line_no): (stays[r.component], r.kept) for r in found}


def test_line_dedup(spark, docs, rows, empty):
    single = [r for i, r in enumerate(rows) if r[0] not in {d for d, _ in rows[:i]}]
    assert spark_lines(spark, single) == brute_lines(single)
    assert line_dedup.line_dedup(docs).count() == sum((t or "").count("\n") + 1 for _, t in rows)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_links_of_documents(spark):
    """Recall over links, not rows: of all pairs of alike lines at least 99 of 100 share a component, and no others do."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    lines = list(dict.fromkeys(n for _, t in rows for x in (t or "").split("\n") if (n := plain_norm(x))))
    links = plain_line_links(lines)
    rows_of = {n: k for k, n in enumerate(lines)}
    component = {}
    for r in line_dedup.line_dedup(d).where("component is not null").join(d, "doc_id").collect():
        component[rows_of[plain_norm(r.text.split("\n")[r.line_no])]] = r.component
    assert len(component) == len(lines) and len(links) > 10
    assert sum(component[a] == component[b] for a, b in links) >= 0.99 * len(links)
    want = brute.union_find(len(lines), links)
    assert len({(component[i], want[i]) for i in range(len(lines))}) == len(set(component.values())) or sum(component[a] != component[b] for a, b in links)


def test_line_twins_among_strangers(spark):
    """Near copies in buckets that a shared passage fills with other lines are all found."""
    r = random.Random(3)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, data = " ".join(letters(11) for _ in range(29)), []
    for i in range(300):
        own = [letters(11) for _ in range(9)]
        data += [(2 * i, passage + " " + " ".join(own)), (2 * i + 1, passage + " " + " ".join([*own[:6], *(letters(11) for _ in range(3))]))]
    got = {x.doc_id: x.component for x in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] != got[2 * i + 1] for i in range(300)) <= 1


def test_copies_of_a_line_that_are_apart_from_each_other(spark):
    """Hundreds of copies that only the common original links: it is found among them, and they are one component."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60)]
    data = [(0, " ".join(words))]
    for i in range(1, 400):
        own = list(words)
        for j in r.sample(range(60), 3):
            own[j] = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8))
        data.append((i, " ".join(own)))
    r.shuffle(data)
    got = {x.doc_id: x.component for x in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(c != got[0] for c in got.values()) <= 4


def near_lines():
    """Pairs of lines that differ in one to three words."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for _ in range(1500):
        a = [letters(11) for _ in range(r.randint(7, 24))]
        b = list(a)
        for i in r.sample(range(len(a)), r.randint(1, 3)):
            b[i] = letters(11)
        yield " ".join(a), " ".join(b)


def lost_pairs(spark, pairs):
    data = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {x.doc_id: x.component for x in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    return sum(got[2 * i] != got[2 * i + 1] for i in range(len(pairs)))


def test_lines_near_the_threshold(spark):
    """Bands find all but one in a hundred of the pairs that are just alike enough."""
    windows = plain_shingles
    near = [(a, b) for a, b in near_lines() if 0.75 <= len(windows(a) & windows(b)) / len(windows(a) | windows(b)) < 0.8]
    assert len(near) > 100 and lost_pairs(spark, near) <= len(near) / 100


def test_lines_with_one_letter_changed(spark):
    """Short lines that differ in a letter are copies; so are the shortest that may differ, and rules of any length."""
    r = random.Random(6)
    lines = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(12))[: r.randint(50, 79)].strip() for _ in range(200)]
    pairs = [(x, x[: (i := r.randrange(len(x)))] + "0" + x[i + 1 :]) for x in lines]
    assert lost_pairs(spark, [*pairs, ("menu 12", "menu 123"), ("-----", "-" * 90)]) == 0


def test_lines_leave(spark):
    d = spark.createDataFrame([(1, "same line of text here\nunique one", 0), (2, "same line of text here", 0), (3, None, 0), (4, "\n", 0), (5, "other words\nsame line of text here\n\nend of it", 0)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_copies(d).collect()}
    assert got == {1: ("same line of text here\nunique one", 0), 3: (None, 0), 4: ("\n", 0), 5: ("other words\n\nend of it", 22)}


def test_lines_leave_rows_of_one_doc_id_alone(spark):
    """Rows with an equal doc_id are texts of their own; clashing columns and nulls do no harm."""
    rows = [(2, "a line that two rows have in common", "x"), (2, "first of its own kind here\na line that two rows have in common", None), (2, "unique words of the third row", "z"), (None, None, "n")]
    out = line_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string, gone string"))
    assert out.columns == ["doc_id", "text", "gone"]
    got = sorted((r.text or "", r.gone or "") for r in out.collect())
    lines = [x for t, _ in got for x in t.split("\n") if x]
    assert sorted(lines) == sorted({x for _, t, _ in rows if t for x in t.split("\n")}) and ("", "n") in got


def test_line_signatures():
    """Windows, sets and pairs as plain code has them, over chunks and for the shortest lines."""
    from paperloom.llm import line_signatures as signatures

    r = random.Random(2)
    lines = ["".join(r.choices("abé日🎉 ", k=r.choice([1, 2, 4, 5, 6, 30, 300]))) for _ in range(900)] + ["x" * 70000, "y"]
    assert list(map(len, signatures.shingle_hashes(lines))) == [len(plain_shingles(x)) for x in lines]
    others = [x[: -r.randint(1, 3)] + "q" if len(x) > 3 else x for x in lines]
    want = [4 * len(plain_shingles(a) & plain_shingles(b)) >= 3 * len(plain_shingles(a) | plain_shingles(b)) for a, b in zip(lines, others, strict=True)]
    assert signatures.alike(lines, others).tolist() == want and 100 < sum(want) < 900
    places, found = signatures.banded(lines)
    assert set(places.tolist()) == set(range(len(lines)))
    again, other = signatures.banded(lines[::-1])
    assert {(lines[p], b) for p, b in zip(places.tolist(), found.tolist(), strict=True)} == {(lines[::-1][p], b) for p, b in zip(again.tolist(), other.tolist(), strict=True)}


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows]
    same(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect(), want)
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_byte_bpe(docs, rows, empty, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := e.encode_ordinary(t or "")), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())) for i, t in rows]
    same(byte_bpe.round_trip(docs, path, P.PATTERN).collect(), want)
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path)
    same(back.collect(), [(i, t or "") for i, t in rows])
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    monkeypatch.setattr(byte_bpe, "ANSWER_BYTES", 100)
    same(byte_bpe.round_trip(docs, path, P.PATTERN).collect(), want)


def test_byte_bpe_takes_each_pretoken_whole():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    find, encode = byte_bpe.pretoken_pattern(P.PATTERN).findall, byte_bpe.piece_encoder(path)
    rng = random.Random(4)
    for text in ["  \n\n  a", "it's", "\x00\u2028\r\n\t", "z" * 5000, " " * 3000 + "x", *("".join(rng.choices("ab'lsé \n\t\u3000字1.-\U0001f600", k=rng.randrange(60))) for _ in range(3000))]:
        assert [i for w in find(text) for i in encode(w.encode())] == one.encode_ordinary(text)


def plain_chats(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    whole = {c: tuple((r.decode(), t.decode()) for _, r, t in sorted(v)) for c, v in convs.items()}
    keep = collections.defaultdict(list)
    for c, v in whole.items():
        if not any(len(o) > len(v) and o[: len(v)] == v for o in whole.values()):
            keep[v].append(c)
    mark = lambda x: re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", x)
    text = lambda v: "".join(f"<|{mark(r)}|>\n{mark(t)}<|end|>\n" for r, t in v)
    return {min((c for c in cs if c is not None), default=None): (text(v), len(v), len(cs)) for v, cs in keep.items()}


CHATS = "conv_id long, turn long, role string, text string, part long, rank long"


def check_chats(spark, rows):
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], CHATS).repartition(3)
    got = collections.defaultdict(lambda: ("", 0, 0))
    found = chat_format.chat_format(df)
    for x in found.orderBy("part").collect():
        got[x.conv_id] = (got[x.conv_id][0] + x.rendered, x.n_turns, x.n_logged)
        assert x.rendered.count("<|end|>") <= chat_format.PART
    assert dict(got) == plain_chats(rows)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat_format.oracle_sql()).df()
    same(found.select(*want.columns).collect(), want.astype(object).where(want.notna(), None).itertuples(index=False))


def test_chat_format(spark):
    r = random.Random(4)
    rows, logs = [], [[(("user", "assistant")[i % 2], word(r)) for i in range(r.randint(1, 9))] for _ in range(12)]
    logs += [x[:k] for x in logs for k in (1, 3)] + [[("user", "a")] * 600, [("user", "a")] * 599, [(None, None)], [("", "")], [("us|>er", "x<|end|>\n<|user|>\ny<\\|end|>")]]
    for c, turns in enumerate(logs):
        start = r.choice([0, 1, 255, -300])
        rows += [(c, start + i, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "nobody"), (500, None, "user", "q"), (500, 3, "assistant", "z"), (500, 3, "assistant", "z")]
    check_chats(spark, rows)
    assert chat_format.chat_format(spark.createDataFrame([], CHATS)).count() == 0


def test_chat_format_with_ties(spark):
    """Turns of equal or no number sort by role and text, for the hashes as for the rendering; many of them make several parts."""
    r = random.Random(8)
    rows = [(c, r.choice([None, 0, 0, 1, 2]), r.choice(["user", "assistant", None]), r.choice("abcd")) for c in range(80) for _ in range(r.randint(1, 5))]
    rows += [(c, t, "user", x) for c, n in ((100, 2), (101, 3)) for t, x in ((1, "b"), (1, "a"), (2, "c"))[:n]] + [(200, 7, "user", str(i)) for i in range(700)]
    check_chats(spark, rows)


def test_lm_scoring(spark, docs, rows, empty):
    got = lm_scoring.lm_scores(docs, lm_scoring.NEUTRAL).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = lambda t: [*brute.WORDS.findall(brute.lowered(t)), ""]
    counts = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        w = words(t)
        want[(d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.lm_scores(empty).count() == 0
    model = plain_lm([t or "" for d, t in rows if not held(d)])
    for r in got[::7]:
        logs, _ = model((next(t for d, t in rows if d == r.doc_id) or "").encode())
        assert any(abs(r.score - float(sum(model((t or "").encode())[0]))) < 1e-6 for d, t in rows if d == r.doc_id), (r.doc_id, sum(logs))


def plain_lm(train):
    """A function from a text to its tokens' log10 and their chances, by counts taken in plain Python."""
    train = [lm_scoring.tokens(t.encode()) for t in train]
    begin = object()
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        for x, y, z in zip([begin, begin, *t], [begin, *t], t):
            one[z] += 1
            two[y, z] += 1
            three[x, y, z] += 1
    total = sum(one.values())
    places, n = lm_scoring.counters(sorted(one))
    flat = np.zeros(2 * lm_scoring.STARTS[-1])
    flat[places] = n
    mixer = lm_scoring.Mixer.of(flat[::2], flat[1::2])
    learners = collections.defaultdict(list)
    import xxhash

    for w in sorted(one, key=xxhash.xxh3_64_intdigest):
        learners[(xxhash.xxh3_64_intdigest(w) >> 32) * lm_scoring.PARTS >> 32].append(w)
    found = []
    for words in learners.values():
        m = lm_scoring.Mixer(mixer.stretched, mixer.confidence)
        m.learn(words)
        found.append(m)
    if found:
        mixer.weights = np.average([m.weights for m in found], axis=0, weights=[len(w) for w in learners.values()])
        mixer.map = np.sum([m.map for m in found], axis=0)
    rate = lambda c: float(np.clip(1 - sum(v == 1 for v in c.values()) / max(1, total), 0.01, 0.99))
    rates = np.array([0.3, rate(three), rate(two), 0.2, rate(one)])

    def scored(*texts):
        block = lm_scoring.Block(list(texts))
        counts = [np.zeros(len(h), np.int64) for h in block.hashes()]
        for i, t in enumerate(map(lm_scoring.tokens, texts)):
            for j, (x, y, z) in enumerate(zip([begin, begin, *t], [begin, *t], t)):
                at = block.starts[i] + j
                counts[0][block.word[at]], counts[1][block.pair[at]], counts[2][block.triple[at]] = one[z], two[y, z], three[x, y, z]
        spelled = np.where(counts[0] > 0, 0.0, 10.0 ** mixer.log10(block.words))
        chances = lm_scoring.Chances(block, 0, len(texts), tuple(counts), total, len(train), rates, spelled)
        return lm_scoring.token_logs(chances), block

    scored.words = one
    return scored


def test_lm_starting_weights(spark):
    """Weights fitted in the job on training texts, as if they had not been learned from, do better on held-out texts than neutral ones."""
    d = spark.read.parquet(f"{LABELLED}/documents.parquet")
    fitted, neutral = (lm_scoring.lm_scores(d, w).where("held_out").agg(F.sum("score")).first()[0] for w in (None, lm_scoring.NEUTRAL))
    assert fitted > neutral


def test_lm_starting_weights_of_all_texts(spark, monkeypatch):
    """what the starting weights are fitted on is the sum over all training texts, not over 400 to 800 of them."""
    r = random.Random(8)
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(1, 12))) for _ in range(1500)]
    got = []
    monkeypatch.setattr(lm_scoring, "stepped", lambda w, sums, f=lm_scoring.stepped: got.append(sums) or f(w, sums))
    lm_scoring.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    block, own = lm_scoring.Block([t.encode() for t in texts]), np.array([not lm_scoring.held_out(i) for i in range(1500)])
    counts = [np.bincount(p[own[block.doc]], minlength=len(h)) for p, h in zip(block.places(), block.hashes())]
    total = int(counts[0].sum())
    again = [float(np.clip(1 - (c == 1).sum() / total, 0.01, 0.99)) for c in counts]
    rates = np.array([0.3, again[2], again[1], 0.2, again[0]])
    want = lm_scoring.Chances(block, 0, 1500, tuple(counts), total, int(own.sum()), rates, np.ones(len(block.words)), lm_scoring.NEUTRAL, own).sums()
    assert len(got) == lm_scoring.TURNS and np.allclose(got[0], want, rtol=1e-5, atol=1e-6)


def test_lm_tokens_of_many_texts():
    r = random.Random(9)
    texts = ["".join(r.choices([" ", "\n", "\x0b", "\x1c", "\x85", "\u2003", "A", "b", "\0", "Ä", "ab"], k=r.choice([0, 1, 2, 30]))).encode() for _ in range(300)]
    for some in (texts, [b""], [b"x"], [b" "], [b"", b"x y", b""], []):
        distinct, at, lengths = lm_scoring.numbered_tokens(some)
        assert [distinct[i] for i in at.tolist()] == [w for t in some for w in lm_scoring.tokens(t)]
        assert lengths.tolist() == [len(lm_scoring.tokens(t)) for t in some] and len(set(distinct)) == len(distinct)


def test_lm_own_counts_left_out():
    """A text's chances without its own counts are those of counts taken from the other texts."""
    r = random.Random(6)
    texts = [" ".join(r.choices("abcdefg", k=r.randint(0, 40))).encode() for _ in range(12)]
    count = lambda of: [collections.Counter(h[p].tolist()) for b in [lm_scoring.Block(of)] for h, p in zip(b.hashes(), b.places())]
    block, every, rates = lm_scoring.Block(texts), count(texts), np.full(5, 0.3)
    numbers = lambda b, c: tuple(np.array([k[h] for h in x.tolist()]) for k, x in zip(c, b.hashes()))
    whole = lm_scoring.Chances(block, 0, len(texts), numbers(block, every), sum(every[0].values()), len(texts), rates, np.full(len(block.words), 0.01), left_out=True)
    for i, t in enumerate(texts):
        alone = lm_scoring.Block([t])
        rest = count(texts[:i] + texts[i + 1 :])
        spelled = np.where(numbers(alone, rest)[0] > 0, 0, 0.01)
        one = lm_scoring.Chances(alone, 0, 1, numbers(alone, rest), sum(rest[0].values()), len(texts) - 1, rates, spelled)
        here = slice(int(whole.starts[i]), int(whole.starts[i] + whole.lengths[i]))
        for name in ("p", "known", "start"):
            assert np.allclose(getattr(whole, name)[:, here], getattr(one, name)), name
        assert np.allclose(whole.spelled[here], one.spelled)


def test_lm_tokens_are_kept_between_fit_and_scores(spark, docs):
    """Texts are cut, counted and joined with their counts once; what is kept gives the same chances."""
    r = random.Random(5)
    texts = [" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randrange(40))).encode() for _ in range(30)]
    block, rates = lm_scoring.Block(texts), np.full(5, 0.3)
    counts = tuple(np.bincount(p, minlength=len(h)) * (1 << 34) * (np.arange(len(h)) % 3 > 0) for p, h in zip(block.places(), block.hashes(), strict=True))
    spelled = np.where(counts[0] > 0, 0, 0.25)
    tokens = lm_scoring.Tokens.of(block, counts, False)
    tokens.spelled = spelled[block.word]
    kept = lm_scoring.Tokens.unpacked(tokens.packed())
    assert [e for _, e in kept.slices(100)][-1] == len(texts) and len(list(kept.slices(100))) > 2
    want = np.concatenate([lm_scoring.token_logs(lm_scoring.Chances(block, a, b, counts, 1 << 40, 9, rates, spelled)) for a, b in [(0, 12), (12, 30)]])
    got = np.concatenate([lm_scoring.token_logs(lm_scoring.Chances.of(kept.part(a, b), 1 << 40, 9, rates)) for a, b in [(0, 12), (12, 30)]])
    assert np.array_equal(got, want)
    assert "Exchange" not in lm_scoring.lm_scores(docs)._jdf.queryExecution().executedPlan().toString()


def test_lm_spelling_sums_to_one():
    """Over all continuations of every prefix the bits leave no more than one unit."""
    r = np.random.default_rng(0)
    words = [bytes(r.integers(97, 101, r.integers(1, 4), dtype=np.uint8)) for _ in range(300)]
    places, n = lm_scoring.counters(words)
    flat = np.zeros(2 * lm_scoring.STARTS[-1])
    flat[places] = n
    mixer = lm_scoring.Mixer.of(flat[::2], flat[1::2])
    mixer.learn(words)
    every = [bytes(p) for k in (1, 2) for p in itertools.product(range(97, 123), repeat=k)] + [b""]
    assert 0.1 < (10.0 ** mixer.log10(every)).sum() <= 1 + 1e-9


def test_lm_tokens_share_one_unit():
    """After any beginning, all words of the corpus, the end and new words have together one unit at most, and most of it."""
    r = random.Random(3)
    names = ["".join(r.choices("abc", k=r.randint(1, 3))) for _ in range(40)]
    scored = plain_lm([" ".join(r.choices(names, k=r.randint(1, 60))) for _ in range(40)])
    new = [bytes(p) for k in (1, 2) for p in itertools.product(range(97, 123), repeat=k) if bytes(p) not in scored.words]
    for size in (0, 1, 2, 40, 70):
        beginning = " ".join(r.choices([*names, "zz"], k=size)).encode()
        mass = 0.0
        for w in [*scored.words, *new]:
            logs, block = scored(beginning + b" " + w)
            mass += 10.0 ** logs[size]
        assert 0.5 < mass <= 1 + 1e-6, (size, mass)


def test_lm_on_documents(spark):
    """Better than the base on training texts and, by words that it knows, on held-out ones; worse on shuffled words; the same whatever the partitions."""
    d = spark.read.parquet(f"{LABELLED}/documents.parquet")
    got = lm_scoring.lm_scores(d).toPandas().sort_values("doc_id")
    held = got[got.held_out]
    assert held.score.sum() > 0.9 * held.base_score.sum() and (got[~got.held_out].score > got[~got.held_out].base_score).mean() > 0.99
    few_new = held[held.n_known > 0.95 * held.n_tokens]
    assert (few_new.score > few_new.base_score).mean() > 0.7
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        again = lm_scoring.lm_scores(d.repartition(3, "doc_id")).toPandas().sort_values("doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.abs(got.score.values - again.score.values).max() < 1e-6
    r = random.Random(1)
    texts = {x.doc_id: (x.text or "").split() for x in d.collect() if x.doc_id in set(held.doc_id)}
    pairs = [(i, w, r.sample(w, len(w))) for i, w in texts.items() if len(w) > 100]
    trained = [x.text or "" for x in d.collect() if not lm_scoring.held_out(x.doc_id)]
    scored = plain_lm(trained)
    better = [scored(" ".join(w).encode())[0].sum() > scored(" ".join(s).encode())[0].sum() for _, w, s in pairs[:40]]
    assert np.mean(better) > 0.9


def test_quality_rules(spark, docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    got, want = quality_rules.quality_rules(docs), con.execute(quality_rules.oracle_sql()).df()
    same(got.select(*want.columns).collect(), want.astype(object).where(want.notna(), None).itertuples(index=False))
    assert quality_rules.quality_rules(empty).count() == 0
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_by_rules(docs).collect()} == kept and quality_rules.kept_by_rules(docs).columns == docs.columns


def test_quality_rules_against_labels(spark):
    d = spark.read.parquet(f"{LABELLED}/documents.parquet")
    got = quality_rules.quality_rules(d).where("n_words >= 50").join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05


def test_media(docs, rows, empty):
    got = {r.doc_id: r for r in media_columns.media_digest(docs).where("doc_id is not null").collect()}
    for i, t in rows:
        if i is None:
            continue
        payload = (t or "").encode()
        payload += b" " * (192 if not payload else -len(payload) % 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media_columns.media_digest(empty).count() == 0
    files = media_columns.encode_media(docs)
    found = media_columns.media_columns(files).toPandas()
    assert len(found) == len(rows) and (found.codec == "raw ").all() and found.error.isna().all()
    bad = docs.sparkSession.createDataFrame([(1, None), (2, b""), (3, b"abc"), (4, media_columns.write_media(b"x" * 384)[:-9])], "doc_id int, media binary")
    assert media_columns.media_columns(bad).where("error is null").count() == 0


def test_media_tables():
    for n in (192, 192 * 64, 192 * 65, 192 * 1000):
        payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        media = media_columns.write_media(payload)
        seen = media_columns.describe(media)
        assert media_columns.read_payload(media) == payload and seen["ticks"] == seen["duration"] == n
        assert all(media[a:b] == payload[i * 192 * 64 : i * 192 * 64 + 192] for i, (a, b) in enumerate(seen["keyframes"]))


def a_track(number, kind, codec, tables, duration=0):
    from paperloom.llm.media_columns import box, full

    head = full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0))
    media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, duration, 0, 0)), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), *tables)))
    return box(b"trak", head, media)


def test_media_of_other_writers():
    """Hand-built files: sound before pictures, 32-bit offsets, half-byte sizes, fragments; and hostile ones."""
    from paperloom.llm.media_columns import box, describe, full

    def sound(at):
        return a_track(1, b"soun", b"mp4a", [full(b"stts", struct.pack(">III", 1, 2, 10)), full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), full(b"stz2", struct.pack(">IIB", 4, 2, 0x35)), full(b"stco", struct.pack(">II", 1, at))], 20)

    def pictures(at):
        tables = [
            full(b"stts", struct.pack(">IIIII", 2, 2, 40, 1, 20)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 2, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 7, 5, 4)),
            full(b"stco", struct.pack(">III", 2, at, at + 10)), full(b"stss", struct.pack(">II", 1, 2)),
        ]
        return a_track(2, b"vide", b"avc1", tables, 100)

    def movie(at):
        return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", sound(at), pictures(at + 8))

    at = len(movie(0)) + 8
    got = describe(movie(at) + box(b"mdat", bytes(40)))
    assert got == {"codec": "avc1", "kind": "vide", "tracks": 2, "timescale": 1000, "duration": 100, "ticks": 100, "samples": 3, "ranges": [(at + 8, at + 15), (at + 18, at + 27)], "keyframes": [(at + 18, at + 23)]}
    none = [full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4))]
    head = box(b"moov", a_track(7, b"vide", b"hvc1", none), box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 30, 4, 0x10000))))

    def fragment(offset, *fields):
        return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"trun", struct.pack(">IiI", 3, offset, 0), struct.pack(">3I", *fields), flags=0x205)))

    moof = fragment(len(fragment(0, 1, 2, 3)) + 8, 6, 4, 5)
    a = len(head) + len(moof) + 8
    got = describe(head + moof + box(b"mdat", bytes(15)))
    assert (got["samples"], got["duration"], got["ranges"], got["keyframes"]) == (3, 90, [(a, a + 15)], [(a, a + 6)])
    good = media_columns.write_media(b"x" * 384)
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    sync0 = a_track(1, b"vide", b"avc1", [full(b"stts", struct.pack(">III", 1, 1, 1)), full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), full(b"stsz", struct.pack(">II", 1, 1)), full(b"stco", struct.pack(">II", 1, 0)), full(b"stss", struct.pack(">II", 1, 0))])
    huge = a_track(1, b"vide", b"avc1", [full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF))])
    for bad in (deep, box(b"moov", sync0), box(b"moov", huge), box(b"moov"), b"", head + moof, good[:-1]):
        assert set(describe(bad)) == {"error"}
    r = random.Random(4)
    for _ in range(3000):
        broken = bytearray(r.choice([good, movie(at) + box(b"mdat", bytes(40)), head + moof + box(b"mdat", bytes(15))]))
        for _ in range(r.randint(1, 4)):
            broken[r.randrange(min(len(broken), 700))] = r.choice([0, 1, 255, r.randrange(256)])
        describe(bytes(broken))


def test_quality_classifier(spark, docs, empty):
    d = spark.read.parquet(f"{LABELLED}/documents.parquet")
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = quality_classifier.quality_classifier(d).join(labels, "doc_id").toPandas()
    assert got[got.label == 1].kept.mean() > 0.99 and got[got.label == 0].kept.mean() < 0.2
    assert quality_classifier.quality_classifier(docs).count() == docs.count()
    assert quality_classifier.quality_classifier(empty).count() == 0
    assert quality_classifier.kept_by_classifier(docs).columns == docs.columns
    rows = {r.doc_id: r for r in quality_classifier.quality_classifier(docs).where("doc_id is not null").collect()}
    assert rows[0].quality == rows[1].quality == rows[2].quality == 0 and not rows[0].kept and all(r.kept == (r.quality >= 0.5) for r in rows.values())
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in quality_classifier.quality_classifier(docs).where("kept").collect())
    assert kept == sorted((r.doc_id is None, r.doc_id or 0) for r in quality_classifier.kept_by_classifier(docs).collect())


def test_estimate_against_plain_loops():
    """One pattern at a time, in plain floats, EM comes to the same accuracies and posteriors."""
    r = random.Random(6)
    patterns = collections.Counter("".join(r.choices("bg-", weights=(1, 3, 2), k=9)) for _ in range(500))
    got, table = quality_classifier.estimate(patterns, rounds=7)
    good = {k: (k.count("g") + 1) / (k.count("g") + 6 * k.count("b") + 2) for k in patterns}
    for _ in range(7):
        share = lambda k, c: good[k] if c else 1 - good[k]  # noqa: B023, E731
        said = {(j, c, v): 1 + sum(n * share(k, c) for k, n in patterns.items() if k[j] == v) for j in range(9) for c in (0, 1) for v in "bg"}
        prior = [1 + sum(n * share(k, c) for k, n in patterns.items()) for c in (0, 1)]
        now = {}
        for k in patterns:
            like = [prior[c] * math.prod(said[j, c, v] / (said[j, c, "b"] + said[j, c, "g"]) for j, v in enumerate(k) if v != "-") for c in (0, 1)]
            now[k] = like[1] / sum(like)
        good = now
    assert all(abs(got[k] - good[k]) < 1e-9 for k in patterns)


def test_scorer_learns_a_plain_rule():
    """A hashed linear scorer trained on soft labels comes close to the rule behind them, on rows that it has not seen."""
    r = np.random.default_rng(1)
    truth = np.where(r.random(200) < 0.5, -3.0, 3.0)
    rows = [(np.sort(r.choice(200, 11, replace=False)), np.ones(11)) for _ in range(3000)]
    target = np.array([1 / (1 + np.exp(-truth[p].sum() / 4)) for p, _ in rows])
    w = quality_classifier.train(rows[:2000], target[:2000])
    found = np.array([w[p] @ v + w[-1] for p, v in rows[2000:]])
    assert ((found > 0) == (target[2000:] > 0.5)).mean() > 0.9


def test_estimate_finds_accuracies():
    r = random.Random(2)
    truth, accuracy = [r.random() < 0.8 for _ in range(4000)], [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.8, 0.85]
    votes = ["".join("-" if r.random() < 0.2 else "bg"[g if r.random() < a else not g] for a in accuracy) for g in truth]
    posterior, table = quality_classifier.estimate(collections.Counter(votes))
    assert np.mean([(posterior[v] > 0.5) == g for v, g in zip(votes, truth, strict=True)]) > 0.97
    assert np.abs(table[:, 1, 1] - accuracy).max() < 0.05


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i, p, a, len(part := ids[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for p, a in enumerate(range(0, len(ids), 4096))]
    got = packing.best_fit_packing(docs, path).collect()
    same([r[:5] for r in got], want)
    for _, g in pd.DataFrame(got, columns=["d", "p", "s", "length", "c", "seq", "offset"]).groupby("seq"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert packing.best_fit_packing(empty, path).count() == 0


@pytest.mark.parametrize("n", [1, 7, 400, 6000])
def test_plan(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(6, 1.2, n).astype(int) + 1, 1, 4096)
    histogram = dict(collections.Counter(lengths.tolist()))
    bins = packing.plan(histogram, 4096)
    used = collections.Counter()
    for inside, k in bins:
        assert sum(inside) <= 4096
        for x in inside:
            used[x] += k
    assert used == histogram
    assert sum(k for _, k in bins) <= sum(k for _, k in packing.best_fit([], collections.Counter(histogram), 4096))


@pytest.mark.parametrize("histogram", [{1500: 999, 1300: 999, 1296: 998}, {2731: 100, 1365: 100}, {4096: 1000, 1: 3000}])
def test_plan_beats_best_fit_where_lengths_are_few(histogram):
    """Such mixes leave best fit up to a sixth above the volume; the program stays at it."""
    count = sum(k for _, k in packing.plan(histogram, 4096))
    assert count <= math.ceil(sum(x * n for x, n in histogram.items()) / 4096) + 1


def test_knapsack_by_items_and_by_rooms():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 9), replace=False))
        values, capacity = rng.random(len(sizes)) * sizes, int(rng.integers(1, 200))
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes.tolist(), values.tolist(), strict=True) if s <= c])
        chosen = packing.knapsack(sizes, values, capacity)
        assert sum(sizes[i] * n for i, n in chosen.items()) <= capacity
        assert math.isclose(sum(values[i] * n for i, n in chosen.items()), best[capacity])
        for form in (packing._by_items, packing._by_rooms):
            assert (form(sizes, values, capacity) >= 0).any() == (best[capacity] > 0)


def test_plan_of_documents():
    """The program's own plan of the larger table needs the volume and no more."""
    import pyarrow.parquet as pq

    encoder, histogram = SpacedEncoder.of(P.path("word_bpe_49k.json")), collections.Counter()
    found = pq.read_table(f"{LABELLED}/documents.parquet", columns=["text"])["text"].to_pylist()
    for ids in encoder.encode_batch([t or "" for t in found]):
        full, rest = divmod(len(ids) + 1, 4096)
        histogram.update({4096: full, rest: rest > 0} if rest else {4096: full})
    histogram = {k: int(n) for k, n in histogram.items() if n}
    assert sum(k for _, k in packing.plan(histogram, 4096)) == math.ceil(sum(x * n for x, n in histogram.items()) / 4096)


def test_spaced_encoder():
    e = SpacedEncoder(P.path("word_bpe_49k.json"), remembered=50)
    for t in texts():
        assert e.encode(t or "").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_spaced_encoder_on_hostile_texts():
    """Every letter with every mark, special tokens in any case, odd spaces: as the library has them."""
    r = random.Random(9)
    letters, marks = [chr(c) for c in (*range(0x21, 0x250), *range(0x370, 0x400), 0x1E9E, 0xFB01, 0x212A, 0x212B, 0x1100, 0x1161)], [chr(c) for c in range(0x300, 0x346)]
    parts = ["<|EndOfText|>", "<|endoftext|>", "<|StartOfText|>", "<|", "'Ll", "'s", "a.", "É,", "ΣİΣİ:", " ", "\n", "\x85", "\x1c", "\u3000", "\u200b"]
    hostile = ["a <|EndOfText|> b", "Ϊ\u0301 x", *(a + b for a in letters for b in marks)]
    hostile += ["".join(r.choice(parts) if r.random() < 0.4 else r.choice(marks) if r.random() < 0.2 else r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(20000)]
    e = SpacedEncoder(P.path("word_bpe_49k.json"))
    want = e.tokenizer.encode_batch(hostile, add_special_tokens=False)
    assert [x.tolist() for x in e.encode_batch(hostile)] == [x.ids for x in want]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, LABELLED), "stage")
        assert after.columns == docs.columns and 0 < after.count() <= before, name
        if name == "quality rules":
            assert quality_rules.quality_rules(after).where("not kept").count() == 0
        if name == "n-gram join":
            groups = brute.jaccard_components([tuple(r) for r in after.select("doc_id", "text").collect()])
            assert all(d == c for d, _, c in groups)
        docs, before = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, LABELLED).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_a_part_of_counts_is_merged_by_ranges(monkeypatch):
    """hashes asked by many blocks are merged range after range; what is held stays near the hashes and counts themselves."""
    import tracemalloc

    import pyarrow as pa
    import xxhash

    chance, pack, planes = np.random.default_rng(3), lm_scoring.pack, lm_scoring._planes
    monkeypatch.setattr(lm_scoring, "counters", lambda words: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(lm_scoring, "MERGED_AT_ONCE", 50_000, raising=False)
    words = [b"a", b"bb", b"never"]
    rows, want = [], [collections.Counter() for _ in range(3)]
    for block in range(20):
        own = sorted(words[: 1 + block % 3], key=xxhash.xxh3_64_intdigest)
        seen = [int(w != b"never") * (block + 1) for w in own]
        want[0].update(dict(zip(own, seen, strict=True)))
        asked = [np.array(list(map(len, own)), np.uint32).tobytes(), b"".join(own), planes(np.array(seen))]
        for k in (1, 2):
            h = np.unique(chance.integers(0, 200_000 if k == 1 else 1 << 63, 50_000 * k).astype(np.uint64)) if block != 7 else np.zeros(0, np.uint64)
            s = chance.integers(0, 3, len(h))
            want[k].update(dict(zip(h.tolist(), s.tolist(), strict=True)))
            asked += [planes(np.diff(h, prepend=np.uint64(0))), planes(s)]
        rows.append((5, block, pack(*asked)))
    table = pa.Table.from_batches([lm_scoring.arrow_rows(lm_scoring._REQUEST, rows)])
    tracemalloc.start()
    out = lm_scoring._count_part(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for (_, block, blob), r in zip(rows, out, strict=False):
        lengths, joined, _, *rest = lm_scoring.unpack(blob)
        keys = [lm_scoring.split_words(lengths, joined), *(np.cumsum(lm_scoring._from_planes(rest[2 * k]), dtype=np.uint64).tolist() for k in (0, 1))]
        assert r["block"] == block and [lm_scoring._from_planes(a).tolist() for a in lm_scoring.unpack(r["answer"])] == [[w[x] for x in ks] for w, ks in zip(want, keys, strict=True)]
    assert out[-1]["totals"] == [t for w in want for t in (sum(w.values()), sum(c > 0 for c in w.values()), sum(c == 1 for c in w.values()))]
    assert lm_scoring.split_words(*lm_scoring.unpack(out[-1]["words"])) == sorted(words[:2], key=xxhash.xxh3_64_intdigest)
    n = sum(len(k) for k in want[1:])
    assert peak < 45 * n


def test_lines_are_compared_by_sorting(monkeypatch):
    """shingle sets come from sorting, not from np.unique's hash table, which takes ten times as long; what is alike is the same."""
    from paperloom.llm import line_signatures

    def never(*args, **more):
        raise AssertionError("np.unique")

    monkeypatch.setattr(np, "unique", never)
    r = random.Random(9)
    lines = ["a", "abcde", "aaaaaaaaaaaa", "日本語のテキスト", "🎉" * 6, *("".join(r.choices("ab é", k=r.randint(1, 300))) for _ in range(60))]
    pairs = [(x, y) for x in lines for y in (x, x + "b", x[: len(x) * 3 // 4] or "a", r.choice(lines), "a" + x)]
    plain = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    want = [4 * len(plain(x) & plain(y)) >= 3 * len(plain(x) | plain(y)) for x, y in pairs]
    assert line_signatures.alike(*map(list, zip(*pairs, strict=True))).tolist() == want and 0 < sum(want) < len(want)
    sets = line_signatures.shingle_hashes(lines)
    assert [len(s) for s in sets] == [len(plain(x)) for x in lines] and all((s[1:] > s[:-1]).all() for s in sets)
    assert line_signatures.alike([], []).tolist() == []
