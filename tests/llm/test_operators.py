"""Each operator against a plain version on small tables, and on odd ones."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import idcoder, idfiles, jaccard, language_id, pretokens, queries
from sparkloom.llm.ann import nearest
from sparkloom.llm.common import materialize, read_table
from sparkloom.llm.idfiles import id_round_trip
from sparkloom.llm.jaccard import jaccard_components
from sparkloom.llm.language_id import accepted, fit, identify
from sparkloom.llm.mixing import fill, mix_sources
from sparkloom.llm.packing import best_fit_decreasing, best_fit_pack, certificate, cut, lower_bound
from sparkloom.llm.token_counts import count_column, token_counts, transducer
from sparkloom.llm.topk import topk
from sparkloom.llm.url_filters import url_filters
from sparkloom.llm.warc import archive, frame_end, read_archives, records_of, warc_round_trip, write_archives
from tests import oracle

PATH = queries.bpe_path()
LONG = "word and more " * 20_000
ODD = [None, "", " ", "\n\n", "a", "it's we're", "x <|endoftext|> y", "ÄÖ über straße 😀 ²", "  two  spaces \t\n end ", LONG, "dup text here now again", "dup text here now again"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark, texts=ODD):
    """Documents with nulls in every column, repeated rows, and extra columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, "x", 1, b"y") for i, t in enumerate(texts)]
    rows += [(None, "null id text of some length", None, None, None, None, None, None), (3, "again", "en", "src1", 5, "x", 1, b"y"), (3, "again", "en", "src1", 5, "x", 1, b"y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, blob binary")


def library():
    return pretokens.tokenizer(PATH)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def nonsense(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


# --- 1 ---


def test_warc(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10_000, None, None), (9_999, "http://x\r\ny", None), (10_001, "u", ""), (None, "n", "<p>only</p>"), (10_002, "a", "<p>ü</p>"), (10_003, "b", "<p>ü</p>"), (10_003, "b", "<p>ü</p>")], "page_id bigint, url string, html string")
    pages = pages.unionByName(extra)
    rows = pages.collect()
    first = {}
    for r in rows:
        first[r["html"] or ""] = min((x for x in (first.get(r["html"] or ""), r["page_id"]) if x is not None), default=None)
    want = []
    for r in rows:
        p = (r["html"] or "").encode()
        f = first[r["html"] or ""]
        kind = "response" if r["page_id"] == f else "revisit"
        want.append((r["page_id"], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, None if kind == "response" else f))
    have = [tuple(r) for r in warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(have, key=key) == sorted(want, key=key)
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_archive_format(spark, tmp_path):
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for x in (f"<html>page {i} of many like it</html>".encode() for i in range(500))]
    data = archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and len(data) < sum(map(len, records))
    assert [b for _, b in records_of(data)][7] == b"<html>page 7 of many like it</html>"
    assert len(list(records_of(archive(records[:3])))) == 3  # too few for a dictionary
    pages = spark.createDataFrame([(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "<p>long enough</p>"), (4, "u", "<p>long enough</p>")], "page_id bigint, url string, html string")
    manifest = write_archives(pages, f"file://{tmp_path}/w", min_revisit_bytes=10)
    (tmp_path / "w" / "left.warc.zst.part").write_bytes(b"what a lost task left")  # not in the manifest
    back = {r["record_id"]: r for r in read_archives(manifest).collect()}
    assert [back[i]["record_type"] for i in "1234"] == ["response"] * 3 + ["revisit"] and bytes(back["3"]["payload"]) == b"<p>long enough</p>" and back["4"]["refers_to"] == "3"


def test_frames_end(spark):
    """Each frame's end is found from its headers: raw, repeated and compressed blocks, many blocks, with a checksum."""
    import zstandard

    r = random.Random(8)
    bodies = [b"", b"a" * 400_000, bytes(r.randrange(256) for _ in range(300_000)), b"some text " * 50_000, b"x"]
    for checksum in (False, True):
        for sized in (False, True):
            press = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=sized)
            frames = [press.compress(x) for x in bodies]
            data, at = memoryview(b"".join(frames)), 0
            for f in frames:
                at += len(f)
                assert frame_end(data, at - len(f)) == at


# --- 2 ---


def test_kneser_ney(spark):
    """Models against the formula with dictionaries: absolute discounts, continuation counts, interpolation."""
    from collections import Counter

    import pandas as pd

    texts = {"x": ["abab cab", "bca abc a", "cab"], "y": ["xyz zyx", "zz yxy abc"]}
    rows, raw = [], {}
    for lang, own in texts.items():
        data = np.frombuffer("".join(own).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in own])])
        sym, at = language_id.symbols(data, off)
        cols = language_id.histories(sym, at)
        keep = np.ones(len(sym), bool)
        keep[at[:-1]] = False
        raw[lang] = [tuple(int(c[i]) for c in cols) for i in np.flatnonzero(keep)]
        rows += [(lang, *g, n) for g, n in Counter(raw[lang]).items()]
    order = language_id.ORDER
    model = language_id.train(pd.DataFrame(rows, columns=["lang", *(f"s{i}" for i in range(order)), "n"]), sorted(texts))
    vocab = len({g[0] for own in raw.values() for g in own}) + 1
    for j, lang in enumerate(sorted(texts)):
        counts = {order: Counter(raw[lang])}
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[:k] for g in counts[k + 1])

        def p(g, k, counts=counts):
            if k == 0:
                return 1 / vocab
            once, twice = (sum(n == v for n in counts[k].values()) for v in (1, 2))
            d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
            same = {h: n for h, n in counts[k].items() if h[1:] == g[1:k]}
            if not same:
                return p(g, k - 1)
            total = sum(same.values())
            return max(same.get(g[:k], 0) - d, 0) / total + d * len(same) / total * p(g, k - 1)

        probe = sorted({g for own in raw.values() for g in own} | {(97, 98, 99, 97), (120, 97, 97, 32), (113, 1, 2, 3)})
        cols = [np.array([g[i] for g in probe], np.int64) for i in range(order)]
        got = model.log_probs(order, language_id.chain(cols), language_id.chain(cols[1:]))[:, j]
        assert np.allclose(got, [np.log2(p(g, order)) for g in probe])


def test_language_id(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 or score > 1 or rejected").count() == 0


def test_language_id_odd(spark):
    text = {"en": "the cat and the dog went into the house with them ", "de": "der hund und die katze gingen in das haus mit ihnen "}
    rows = [(i, text[lang] * (1 + i % 3), lang) for i, lang in enumerate(["en", "de"] * 40)] + [(900, None, "en"), (901, "text without label", None)]
    model = fit(spark.createDataFrame(rows, "id bigint, text string, lang string"))
    odd = odd_docs(spark, [*ODD, "the dog", "das haus", "12 34 !!", "жзшч ъыфх цщюя " * 30])
    out = {(r["doc_id"], i): r for i, r in enumerate(identify(odd, model).collect())}
    assert len(out) == odd.count()
    by = {k[0]: v for k, v in out.items()}
    n = len(ODD)
    assert by[n]["lang_pred"] == "en" and by[n + 1]["lang_pred"] == "de" and by[0]["lang_pred"] == "und" and by[n + 2]["lang_pred"] == "und" and by[0]["score"] == 0
    assert by[n + 3]["rejected"] and not by[n]["rejected"] and by[0]["rejected"]
    # the probabilities of all symbols after a context sum to one
    from sparkloom.llm.language_id import chain

    symbols = np.array(sorted({ord(c) for t in text.values() for c in t}))  # the vocabulary but for the unknown symbol
    for ctx in ([104, 116, 32], [122, 113, 120]):
        cols = [symbols, *(np.full(len(symbols), c) for c in ctx)]
        total = np.exp2(model.log_probs(4, chain(cols), chain([*cols[1:], cols[0]]))).sum(0)
        assert (total < 1 + 1e-9).all() and (total > 0.9).all()
    assert fit(spark.createDataFrame([], "id bigint, text string, lang string")) is None
    assert {r["lang_pred"] for r in identify(odd, None).collect()} == {"und"}


def test_language_id_keeps_its_own(spark):
    """No row whose prediction is its label is rejected, however few texts the limit rests on; far ones are."""
    text = {"en": "the cat and the dog went into the house with them ", "de": "der hund und die katze gingen in das haus mit ihnen "}
    rows = [(i, text[lang] * (1 + i % 3), lang) for i, lang in enumerate(["en", "de"] * 40)]
    odd = [(1000, "der hund fbcadeebfdcabbedfaceb und qxzvjwkqpyx", "de"), (1001, "the dog " + "zqxjvkwyqpzb " * 12, "en"), (None, "the cat " + "vqxzjkwpyqbz " * 14, "en")]
    far = [(2000, "жзшч ъыфх цщюя " * 300, None)]
    docs = spark.createDataFrame([*rows, *odd, *far], "doc_id bigint, text string, lang string")
    model = fit(docs.withColumnRenamed("doc_id", "id"), docs_per_lang=30)
    out = {r["doc_id"]: r for r in identify(docs, model).collect()}
    wanted = [(i, lang) for i, _, lang in [*rows, *odd] if out[i]["lang_pred"] == lang]
    assert {1000, 1001, None} & {i for i, _ in wanted} and all(not out[i]["rejected"] for i, _ in wanted)
    assert any(out[i]["bits_per_char"] > model.limits[model.langs.index(lang)] for i, lang in wanted) and out[2000]["rejected"]
    assert {r["doc_id"] for r in accepted(docs, model).collect()} == {i for i, r in out.items() if not r["rejected"]} >= {i for i, _ in wanted}


# --- 3 ---


def test_token_counts(spark):
    texts = [*ODD, *nonsense(1, 300, "aab s'  \n\t 　éüтест中12²'srevlmdt.,!?-<|>_ \r\x1c\x85"), *nonsense(2, 300, "theraninonesdgk"), "ab" * 3000, "a" * 5000, " " * 3000]
    out = {r["doc_id"]: r for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(t))
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((t or "").encode()), n, n > 512), repr(t)[:80]
    assert token_counts(odd_docs(spark), PATH).count() == len(ODD) + 3
    assert token_counts(odd_docs(spark).limit(0), PATH).count() == 0


def test_token_counts_without_borders():
    """Long texts in one piece: every chunk hands its state on."""
    r = random.Random(6)
    texts = ["".join(r.choice(a) for _ in range(n)) for a in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "aé漢b", "!?", "0123456789") for n in (511, 512, 1_600, 5_000)]
    texts += ["ab " + "x" * 3_000 + " the end", "-" * 4_000, "the" * 2_000]
    _, got = count_column(pa.array(texts), PATH)
    assert got.tolist() == [len(ids_of(t)) for t in texts]


def test_transducer_starts_anew(monkeypatch):
    machine = transducer(PATH)
    monkeypatch.setattr(type(machine), "LIMIT", 10)
    raw = np.frombuffer(b"starting over must not change what is counted", np.uint8)
    want = len(ids_of(raw.tobytes().decode()))
    for _ in range(3):
        assert machine.counts(raw, np.array([0, len(raw)])).tolist() == [want]


# --- 4 ---


@pytest.mark.parametrize("limit", [100_000, 0])  # broadcast rules, shuffled rules
def test_url_filters(spark, limit, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.url_filters.BROADCAST_RULES", limit)
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.example.com/en/q?x#y", "http://xexample.com/en/", "http://com", "http://com/", "ftp://n.net/es/1", "http://n.net/eso", "http://n.net?/es/", "http://ÄB.net/fr/", "http://u:p@n.net:80/es/", "http://..net/fr/", "x://y://z.com/"]
    rows = [(i, u, "h", 1) for i, u in enumerate(urls)] + [(4, urls[4], "h", 1), (None, urls[4], None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, short int")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    upper = {c: c + 32 for c in range(65, 91)}

    def judge(u):
        rest = (u or "").partition("://")[2]
        host = re.split(r"[/?#]", rest)[0].translate(upper)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    have = sorted((tuple(r) for r in url_filters(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert have == sorted(((r[0], *judge(r[1])) for r in rows), key=str)
    assert url_filters(pages.limit(0), rules).count() == 0


def test_url_filters_sql(spark, sf):
    oracle.assert_same(queries.op4_url_filters(spark, sf), oracle.connect(sf), queries.OP4_SQL)


# --- 5 ---


def brute_components(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in held[g]:
                common[j] += 1
            held[g].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[find(i)] = min(d, name.get(find(i), d))
    return [(d, len(sets[i]), name.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_jaccard_join(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t + [r.choice(words)] * r.choice([0, 0, 1])))
    passage = " ".join(r.choice(words) for _ in range(40))
    rows += [passage + " " + " ".join(r.choice(words) for _ in range(r.choice([2, 5, 10, 30]))) for _ in range(40)]
    # a chain: neighbours are linked, far ones are not
    chain = [r.choice(words) for _ in range(300)]
    rows += [" ".join(chain[10 * i : 10 * i + 120]) for i in range(15)]
    rows += ["UPPER and Lower words here", "upper AND lower words HERE", "a b", "A B", *[t for t in ODD if t is None or len(t) < 1000]]
    r.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, "a b"), (None, "only null ids share this text"), (None, "only null ids share this text"), (2, "x y z")]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id bigint, text string, cid string, key int")
    have = sorted(tuple(x) for x in jaccard_components(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1))).collect())
    assert have == sorted((-1 if d is None else d, n, -1 if c is None else c) for d, n, c in brute_components(rows))
    assert jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_hot_group(spark):
    """A large group of near copies, most pairs of which are near the line: none of its links may be lost."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(1000)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(r.choice([1, 2, 3])):
            t[r.randrange(len(t))] = f"n{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(x) for x in jaccard_components(docs).collect()) == sorted(brute_components(rows))


@pytest.mark.parametrize("blocks", [(1000, 1_000_000), (7, 900)])
def test_jaccard_links(spark, blocks, monkeypatch):
    """Every link is counted, within components too: near copies, a chain, equal texts, odd rows."""
    monkeypatch.setattr(jaccard, "BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", blocks[1])
    r = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    base, chain = [r.choice(words) for _ in range(150)], [r.choice(words) for _ in range(300)]
    texts = [" ".join(f"n{i}" if k == i or i % 3 == 0 and k == 3 * i else w for k, w in enumerate(base)) for i in range(40)]
    texts += [" ".join(chain[10 * i : 10 * i + 120]) for i in range(15)]
    texts += [texts[0], texts[0], texts[41], "a b", "A B", "one two three", *[t for t in ODD if t is None or len(t) < 1000]]
    rows = [*enumerate(texts), (None, "a b")]
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [sum(linked(a, b) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    same = [sum(a == b and bool(a) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    assert sum(want) > sum(same) + 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [tuple(x) for x in jaccard_components(docs, links=True).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1)), "n_links").collect()]
    brute = [(-1 if d is None else d, n, -1 if c is None else c, k) for (d, n, c), k in zip(brute_components(rows), want, strict=True)]
    assert sorted(out) == sorted(brute)
    assert jaccard_components(docs.limit(0), links=True).count() == 0


def test_jaccard_many_classes_of_one_key(spark):
    """A passage that more classes share than one block holds: no link through it, and all links beside it."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common = " ".join(word() for _ in range(12))
    rows = []
    for i in range(1_300):
        own = [word() for _ in range(14)]
        rows.append((2 * i, f"{common} {' '.join(own)}"))
        if i % 10 == 0:  # a near copy, one word longer
            rows.append((2 * i + 1, f"{common} {' '.join([*own, word()])}"))
    have = {(x["doc_id"], x["component_id"]) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert have == {(d, d - d % 2 if d // 2 % 10 == 0 else d) for d, _ in rows}


def test_jaccard_query_gives_links(spark, sf):
    assert queries.op5_jaccard_join(spark, sf).where("n_links > 0").count() > 0


# --- 6 ---


def test_fill():
    got = fill([100, 100, 800, 0], [5, 2, 1, 5], 3)
    assert got[0] == 300 and got[1] == 300 and abs(sum(got) - 1000) < 1e-9 and got[2] == 400 and got[3] == 0
    assert fill([], [], 3) == []


def test_mixing(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = mix_sources(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    want = fill([sizes[s] for s in sorted(sizes)], [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    longest = max(r["size"] for r in out)
    for s, t in zip(sorted(sizes), want, strict=True):
        assert abs(target[s] - t) < 1e-6 * t and abs(taken[s] - t) <= longest
    assert abs(sum(taken.values()) - sum(sizes.values())) <= longest
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in mix_sources(docs.repartition(3)).collect()}


def test_mixing_sql_on_small_tables(spark):
    """Ties, tiny sources, documents larger than targets, null and repeated ids."""
    import duckdb

    r = random.Random(5)
    tables = [[(0, "a", 3), (1, "c", 1), (2, "a", 2)], [(0, "c", 3), (1, "c", 3), (2, "c", 5), (3, "b", 40), (4, "a", 2), (5, "a", 10)]]
    for _ in range(10):
        names = r.sample(["a", "b", "c", "d", None, ""], r.randint(1, 5))
        tables.append([(r.choice([i, i, i, None, 1]), r.choice(names), r.choice([0, 1, 2, 3, 5, 10, 40])) for i in range(r.randint(1, 14))])
    for table in tables:
        rows = [(i, " ".join(["w"] * n), s) for i, s, n in table]
        con = duckdb.connect()
        con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        oracle.assert_same(mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).drop("finish"), con, queries.OP6_SQL)


def test_mixing_odd(spark, monkeypatch):
    docs = odd_docs(spark)
    out = mix_sources(docs).collect()
    assert len(out) == docs.count() and all(r["taken"] == 0 for r in out if not WORD.findall(r["source"] or "x")) and all(r["size"] == 0 or r["source_size"] >= r["size"] for r in out)
    assert mix_sources(docs.limit(0)).count() == 0 and all(r["taken"] == 0 for r in mix_sources(docs.where("doc_id in (0, 1)")).collect())
    monkeypatch.setattr("sparkloom.llm.mixing.GROUP_ROWS", 2)  # many ranges give the same mix
    assert sorted(str(r["doc_id"]) + str(r["taken"]) for r in mix_sources(docs).collect()) == sorted(str(r["doc_id"]) + str(r["taken"]) for r in out)


# --- 7 ---


@pytest.mark.parametrize("ids", [[], [5], [65535] * 300, list(range(9000)), [0] * 20_000, random.Random(1).choices(range(65536), k=9000), random.Random(2).choices(range(40), k=20_000)])
def test_coder(ids):
    ids = np.array(ids, np.int32)
    blocks = idcoder.encode(ids)
    assert (idcoder.decode(blocks) == ids).all()
    if len(blocks) > 1:  # a block stands alone
        assert (idcoder.decode(blocks[1:2]) == ids[idcoder.BLOCK : 2 * idcoder.BLOCK]).all()
    data = idfiles.pack_file([1], np.array([len(ids)]), ids)
    assert (idfiles.unpack_file(data)[2] == ids).all()
    if len(ids) > 100:
        bad = bytearray(data)
        bad[-60] ^= 1
        with pytest.raises(ValueError):
            idfiles.unpack_file(bytes(bad))


def test_coder_compresses():
    ids = np.array([w for i in range(4000) for w in (17, 300 + i % 7, 9, 4)], np.int32)
    assert sum(len(w) for _, w in idcoder.encode(ids)) * 2 < len(ids) / 2


@pytest.mark.parametrize("width", [2, 300, 65536])
def test_order_0_shares_are_those_of_counted_ids(width):
    block = (np.arange(700) ** 2 % 1009 * 64) % width
    block[-3:] = width - 1, 0, width - 1
    low, high = idcoder._runs(block, width)
    shares = idcoder._Shares(width)
    for t, x in enumerate(block.tolist()):
        if t in idcoder.RENEW:
            shares.renew(np.repeat(block[:t, None], 3, axis=1))
        seen = max((r for r in idcoder.RENEW if r <= t), default=0)
        share = np.bincount(block[:seen], minlength=width) * ((idcoder.ZERO - width) // seen) + 1 if seen else np.full(width, idcoder.ZERO // width)
        ends = np.append(np.cumsum(share) - share, idcoder.ZERO)
        assert (low[t], high[t]) == (ends[x], ends[x + 1])
        lanes, at = np.array([0, 2, 2]), np.array([low[t], high[t] - 1, (low[t] + high[t]) // 2])
        assert all((f == w).all() for f, w in zip(shares.find(lanes, at), (x, low[t], high[t]), strict=True))


def test_coder_carries():
    """A carry goes through words of ones, in the lane that it is in only."""
    coder, whole = idcoder._Encoder(2, 20), 1 << idcoder._ALL_BITS
    for _ in range(3):
        coder.code(2, np.zeros(2, np.int64), np.full(2, 1 << 10))
    coder.lo[:] = (1 << 64) - 1, 5  # lane 0 carries into all that it has given
    coder.words[1 : coder.pos[0]] = 0xFFFF
    coder.words[1] = 6
    other = coder.words[20 + 1 : coder.pos[1]].copy()
    coder.code(2, np.array([whole // 2, 0]), np.array([whole // 4] * 2))
    zero, one = coder.finish()
    assert zero[1] == 7 and not zero[2:4].any() and (one[1 : 1 + len(other)] == other).all()


def test_coder_round_trips_shapes():
    r = np.random.default_rng(3)
    for n in (1, 2, 31, 33, idcoder.BLOCK - 1, idcoder.BLOCK, idcoder.BLOCK + 1, 34 * idcoder.BLOCK + 7):
        for top in (1, 2, 1000, 65536):
            ids = np.minimum(r.integers(0, top, n), r.integers(0, top, n)).astype(np.int32)
            assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_new_pieces_keep_their_order():
    """Pieces with and without line ends are encoded apart; each gets its own number, without the pattern being matched anew."""
    own = pretokens.IdEncoder(PATH)
    pieces = [" the", "\n\n", "   ", "Ċ", " \n", "'s", "été", "\t", "\n", "a" * 60, "\u3000", "12"]
    for part in (pieces[:7], pieces[7:]):
        keys = np.array([hash(x) & 0xFFFFFFFF for x in part], np.uint64)
        numbers = own._add(keys, [x.encode() for x in part])
        assert (own._find(keys) == numbers).all()
        assert [own.ids[own.off[k] : own.off[k] + own.len[k]].tolist() for k in numbers.tolist()] == [ids_of(x) for x in part]


def test_id_files(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "RANGE_CHARS", 100_000)
    docs = odd_docs(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (-1 if r[0] is None else r[0]))
    have = id_round_trip(docs, PATH).collect()
    want, start = defaultdict(list), 0
    for d, t in rows:
        ids = [*ids_of(t), 0]
        want[d].append((len(ids), crc(ids)))
    got = defaultdict(list)
    for r in sorted(have, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        got[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r["doc_id"] for r in sorted(have, key=lambda r: r["start"])] == [d for d, _ in rows]
    assert id_round_trip(docs.limit(0), PATH).count() == 0


# --- 8, 9 ---


def vectors(spark, n=400, dim=16, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(dim)], "q", 1) for i in range(n)]
    rows += [(n, None, "q", 1), (n + 1, [None] * dim, "q", 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), "q", 1), (n + 3, [float("inf")] * dim, "q", 1), (n + 4, [0.0] * dim, "q", 1), (7, rows[9][1], "q", 1), (20, rows[20][1], "q", 1), (None, rows[1][1], "q", 1)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, query_id string, qb int"), rows


@pytest.mark.parametrize("blocks", [(512, 8192), (7, 50)])
def test_topk(spark, blocks):
    df, rows = vectors(spark)
    good = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, w in good:
        if q % 20 == 0:
            best = sorted((-int(w @ c), i) for i, c in good if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)} if q != 20 else set()
    have = {tuple(r) for r in topk(df, F.col("id") % 20 == 0, 5, query_block=blocks[0], candidate_block=blocks[1]).collect()}
    assert {h for h in have if h[0] != 20} == want
    assert topk(df.limit(0), F.col("id") % 20 == 0).count() == 0 and topk(df.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_topk_sql(spark, sf):
    oracle.assert_same(queries.op8_topk(spark, sf), oracle.connect(sf), queries.OP8_SQL)


def test_nearest(spark):
    df = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    ids, v = zip(*((r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()), strict=True)
    ids, v = np.array(ids), np.stack(v)
    have = defaultdict(dict)
    for r in nearest(df, F.col("id") % 100 == 0).collect():
        have[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in have[q].items()) and len(have[q]) == 10
        hits += len({ids[i] for i in order} & set(have[q]))
        total += 10
    assert hits / total >= 0.99


def test_nearest_odd(spark):
    df, rows = vectors(spark)
    out = nearest(df, F.col("id") % 100 == 0, 10, query_block=2, candidate_block=60).collect()
    good = {i for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    assert {r["query_id"] for r in out} == {i for i in good if i % 100 == 0} and {r["vec_id"] for r in out} <= good
    assert all(r["query_id"] != r["vec_id"] for r in out) and max(r["rank"] for r in out) == 10
    assert nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0 and nearest(df.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


# --- 10 ---


def test_bounds():
    r = random.Random(4)
    for _ in range(50):
        n = np.array([r.choice([r.randint(1, 100), r.randint(30, 60), 51]) for _ in range(r.randint(0, 60))], np.int64)
        b, offset, bins = best_fit_decreasing(n, 100)
        fill_ = np.bincount(b, n, bins) if len(n) else np.zeros(0)
        assert (fill_ <= 100).all() and lower_bound(n, 100) <= bins
        for k in range(bins):
            own = sorted((offset[i], n[i]) for i in np.flatnonzero(b == k))
            assert all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:])) and own[0][0] == 0
    assert lower_bound(np.array([51] * 7), 100) == 7 and lower_bound(np.array([34] * 9), 100) == 5 and lower_bound(np.array([60, 60, 40, 41]), 100) >= 3
    assert cut(5000, 2048) == [904, 2048, 2048] and cut(4096, 2048) == [2048, 2048] and cut(1, 2048) == [1]


@pytest.mark.parametrize("pieces", [40_000, 4])
def test_packing(spark, pieces, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.packing.PARTITION_PIECES", pieces)
    docs = odd_docs(spark)
    out = best_fit_pack(docs, PATH).collect()
    whole = {i: [*ids_of(t), 0] for i, t in enumerate(ODD) if i != 3}
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] in whole:
            ids = whole[r["doc_id"]]
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 2048
    total = sum(r["length"] for r in out)
    assert total == sum(len(ids_of(r["text"])) + 1 for r in docs.collect())
    assert len(by) <= -(-total // 2048) + (1 if pieces > 4 else 4)
    for d, ids in whole.items():
        mine = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == d)
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(ids) and all(m[2] == 2048 for m in mine[1:])
    assert best_fit_pack(docs.limit(0), PATH).count() == 0


# --- shared ---


def test_packing_certificate(spark):
    packed = materialize(queries.op10_best_fit_pack(spark, "/root/testdata/sf0.01"))
    bins, bound = certificate(packed)
    assert bound <= bins <= bound + 2 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_topk_refuses_overflow(spark):
    rows = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk(rows, F.col("id") % 20 == 0).collect()


def test_encoder(spark):
    texts = [*(t for t in ODD if t), *nonsense(7, 400, "aab s'  \n\t 　éüт中12²'srevlmdt.,!?-<|>_ \r\x1c\x85"), *nonsense(8, 400, "' srevltmd\na1.")]
    import pyarrow as pa

    from sparkloom.llm.common import slices, text_buffers

    e = pretokens.IdEncoder(PATH)
    e.LIMIT = 500  # starts anew many times
    raw, off = text_buffers(pa.array(texts))
    got = []
    for i, j in slices(off, 2000):
        ids, at = e.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
    assert got == [ids_of(t) for t in texts]
