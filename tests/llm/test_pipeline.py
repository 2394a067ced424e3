"""The corpus pipeline and the thin queries against plain Python versions, and their SQL against DuckDB."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from contactloom.llm import media, ngram_join, queries, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _texts():
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        base = [words[k] for k in r.integers(0, 300, 40 + i % 30)]
        if i % 5 == 0:
            base.insert(3, "vileword")
        texts.append(" ".join(base))
        if i % 4 == 1:
            texts.append("  ".join(base) + "\n")  # an exact copy but for blanks
        if i % 6 == 1:
            texts.append(" ".join([*base[:-1], "changed"]))  # a near copy
    return [*texts, None, "", " ", "lone", "é" * 3000]


def _tables(spark, folder):
    rows = [(i, t, "en", None if i % 17 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(_texts())]
    docs = spark.createDataFrame([*rows, (None, "an orphan of five words", "en", "s1", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("vileword" in (t or ""))) for i, t in enumerate(_texts())]
    spark.createDataFrame([*labels, (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def _plain(docs, model):
    """All five stages in plain Python: doc_id, and how often it is taken."""
    kept = [d for d in docs if model.score(d.text) < toxicity.CUT]
    best = {}
    for d in kept:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d.text or ""), []).append((-len(d.text or ""), d.doc_id is None, d.doc_id or 0, d))
    kept = [min(v, key=lambda x: x[:3])[3] for v in best.values()]
    sets = {id(d): frozenset(ngram_join.shingles(d.text).tolist()) for d in kept}
    group = {id(d): {id(d)} for d in kept}
    for a in kept:
        for b in kept:
            x, y = sets[id(a)], sets[id(b)]
            if a.doc_id is not None and b.doc_id is not None and x and y and len(x & y) >= 0.8 * len(x | y):
                joined = group[id(a)] | group[id(b)]
                for k in joined:
                    group[k] = joined
    low = {id(d): d.doc_id for d in kept}
    kept = [d for d in kept if d.doc_id is None or d.doc_id == min((low[k] for k in group[id(d)] if low[k] is not None), default=None)]
    size = {id(d): len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in kept}
    total = {}
    for d in kept:
        total[d.source] = total.get(d.source, 0) + size[id(d)]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * total[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    out = []
    for d in kept:
        rate = target[d.source] / total[d.source] if total[d.source] else 0.0
        word = str(d.doc_id) if d.doc_id is not None else "~" + (d.text or "")
        u = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) / 2**32
        out += [d] * (int(rate) + int(u < rate - int(rate)))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs, _ = _tables(spark, tmp_path)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in _plain(docs.collect(), model):
        ids = coder.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # every decision takes effect: nothing toxic stays, copies go, some documents are taken twice
    ids = [x[0] for x in got]
    texts = dict(enumerate(_texts()))
    assert not any("vileword" in (texts[i] or "") for i in ids if i is not None) and len(set(ids)) < len(texts) - 12 and len(ids) > len(set(ids))


def test_queries_against_plain_versions_and_sql(spark, tmp_path):
    docs, labels = _tables(spark, tmp_path)
    rows = {r.doc_id: r for r in docs.collect()}
    found = queries.queries()
    for r in found["op2_media"](spark, str(tmp_path)).collect():
        data = (rows[r.doc_id].text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        file = media.store(data)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        rgb = media.Image(file).pixels()
        assert rgb.shape == (r.height, r.width, 3) and r.rgb_sha256 == hashlib.sha256(rgb.tobytes()).hexdigest()
    judged = found["op7_toxicity"](spark, str(tmp_path)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in judged) and len(judged) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in judged if r.doc_id is not None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_exact_dedup", "op10_mixing"):
        got = found[name](spark, str(tmp_path))
        want = con.execute(queries.oracle_sql()[name])
        order = sorted(c[0] for c in want.description)
        at = [[c[0] for c in want.description].index(c) for c in order]
        shown = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(got.columns) == order
        assert sorted([tuple(shown(r[c]) for c in order) for r in got.collect()], key=str) == sorted([tuple(shown(r[i]) for i in at) for r in want.fetchall()], key=str), name
