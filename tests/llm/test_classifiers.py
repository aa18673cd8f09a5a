"""Toxicity, quality, licences, secrets: held-out accuracy and awkward rows."""

from __future__ import annotations

import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.llm import learn, licenses, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("name", "label", "mod", "out"), [("op9_toxicity", "toxic", 5, 0), ("op6_quality_classifier", "quality", 4, 2)])
def test_held_out(spark, labels, name, label, mod, out):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "quality" else 0.5)) for r in rows)
    y = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    # forty to sixty positives of either class only: the larger tables give 99 %
    assert sum(a == b for a, b in held) / len(held) > (0.95 if label == "quality" else 0.9)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_awkward_scores(spark, labels, docs_of, awkward, run):
    train = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs_of([]))
    more = train.select("doc_id", "text").unionByName(docs_of(awkward, extra=True).selectExpr("doc_id + 10000000 as doc_id", "text"))
    rows = [r for r in run(more, labels).collect() if r.doc_id is None or r.doc_id > 10**7]
    assert len(rows) == len(awkward)
    assert all(r.score is not None for r in rows)
    blank = {round(r.score, 12) for r in rows if r.doc_id in (10**7 + 1, 10**7 + 2)}
    assert len(blank) == 1
    repeated = [r.score for r in rows if r.doc_id == 10**7 + 6]
    assert len(repeated) == 2 and repeated[0] == pytest.approx(repeated[1])
    assert [r.held_out for r in rows if r.doc_id is None] == [None]


def test_no_labels_and_empty_tables(docs_of, labels):
    none = labels.limit(0)
    d = docs_of({1: "a", 2: None})
    assert [r.predicted for r in toxicity.toxicity(d, none).collect()] == [0, 0]
    assert [r.predicted for r in quality.quality(d, none).collect()] == [1, 1]
    assert toxicity.toxicity(docs_of({}), labels).count() == 0
    assert quality.quality(docs_of({}), labels).count() == 0
    kept = toxicity.drop_toxic(docs_of({1: "a", None: None}, extra=True), none)
    assert kept.count() == 2 and kept.columns == docs_of({}, extra=True).columns


def test_licenses(docs_of, awkward):
    texts = {100: "Hello there.\nReleased under the MIT License.\nMore text.",
             101: "This work is licensed under the GNU General Public License, version 3.",
             102: "intro " * 30 + "Licensed under the Apache License, Version 2.0. " + "tail " * 30,
             103: "The apache tribe has a public library with a general license to fish.",
             104: "LICENSED!! UNDER!! CC!! BY-NC!! 4.0!!", 105: "Ünï\nLicensed under CC BY-NC 4.0.\n"}
    out = licenses.scan(docs_of([*texts.items(), *awkward], extra=True)).where("confirmed").collect()
    got = {r.doc_id: r.family for r in out}
    assert {k: got.get(k) for k in (100, 101, 102, 105)} == {100: "MIT", 101: "GPL", 102: "Apache-2.0", 105: "CC-BY-NC"}
    assert 103 not in got and not any(r.doc_id is None or r.doc_id < 100 for r in out)
    r = next(r for r in out if r.doc_id == 105)
    assert texts[105][r.start:r.start + r.length] == "Licensed under CC BY-NC 4.0"
    assert licenses.scan(docs_of({})).count() == 0


@pytest.fixture(scope="module")
def license_model(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = [(r.text or "").split("\n") for r in rows]
    return licenses.fit(sorted("\n".join(t[i % len(t):][:3])[:400] for i, t in enumerate(texts)))


def found(m, text, **how):
    raw = np.frombuffer(text.encode(), np.uint8)
    return licenses.paragraphs(m, raw, np.array([0, len(raw)]), **how)


@pytest.mark.parametrize("mark", ["#", " *", "//", ""])
def test_wrapped_notices_are_named_once(license_model, mark):
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            header = "\n".join(f"{mark} {x}" for x in textwrap.wrap(t, 50))
            got = found(license_model, f"intro of a file\n\n{header}\n\nimport os")
            assert [x[3] for x in got if x[6]] == [family], t


def test_whole_headers(license_model):
    lgpl = (licenses.PARAGRAPHS["LGPL"][0] + " This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
    texts = {"LGPL": " * " + "\n * ".join(textwrap.wrap(lgpl, 60)), "MIT": "\n".join(textwrap.wrap(licenses.PARAGRAPHS["MIT"][2], 70)),
             "Apache-2.0": "\n".join(f"# {x}" for x in textwrap.wrap(licenses.PARAGRAPHS["Apache-2.0"][0], 60))}
    for family, text in texts.items():
        assert [x[3] for x in found(license_model, text) if x[6]] == [family]


def test_other_licenses_are_unknown(license_model):
    """Licences that neither the families nor the unknown class hold."""
    names = ("Eclipse Public License, version 2.0", "Common Public Attribution License Version 1.0", "Sleepycat License", "Ruby License",
             "Open Government Licence v3.0", "Intel Open Source License", "Creative Commons Sampling Plus 1.0 License")
    for t in licenses.NOTICES:
        for n in names:
            assert not [x for x in found(license_model, t.format(n)) if x[6]], n


def test_license_screen_loses_nothing(spark, license_model):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]
    texts += ["x " * 50 + "\n".join(textwrap.wrap(t, 40)) for own in licenses.TEMPLATES.values() for t in own[-2:]]
    assert all(found(license_model, t) == found(license_model, t, screened=False) for t in texts)


def test_license_rows(docs_of):
    """Repeated rows, a very long line, clashing columns, no id."""
    long_line = "one two three " * 50_000 + "Licensed under the Apache License, Version 2.0. " + "four five six " * 50_000
    d = docs_of([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, long_line), (None, "Released under the ISC License."),
                 (3, "dup " * 400), (4, None)], extra=True).withColumn("family", F.lit("x")).withColumn("probability", F.lit("y"))
    out = licenses.scan(d)
    got = sorted((str(r.doc_id), r.family) for r in out.where("confirmed").collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("2", "Apache-2.0"), ("None", "ISC")]
    assert out.columns == ["doc_id", "start", "length", "family", "probability", "similarity", "confirmed"]


def test_toxicity_margins_meet_every_feature():
    """Features that share a slot of the lookup all count: compared with a dictionary."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc d") for _ in range(300)) for _ in range(20)] + ["", "ab"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    data, off = np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    per = [set().union(*(toxicity.ngram_keys(r, np.array([0, len(r)]), o)[0].tolist() for o in toxicity.ORDERS)) for r in raw]
    # keys whose upper bits fall together as well
    keys = np.unique(np.array(sorted(set().union(*per)) + [k ^ 1 for k in per[0]], np.uint64))
    v = np.array([rng.uniform(-1, 1) for _ in keys])
    m = toxicity._model(keys, v, 0.25)
    value = dict(zip(keys.tolist(), m.weights.tolist(), strict=True))
    assert toxicity.margins(m, data, off) == pytest.approx([0.25 + sum(value.get(k, 0.0) for k in ks) for ks in per])


def test_fit_holds_one_array_of_indexes(monkeypatch):
    """The driver holds the sample's n-grams once, as indexes; values are one a feature, not one an entry."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["calm", "kind", "warm"] if i % 2 else ["vile", "grim", "foul"]) + f"{rng.randrange(9)}" for _ in range(30)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)], float)
    seen = []

    def noted(ptr, idx, val, y, n, **kw):
        seen.append((ptr.copy(), idx, val, n, kw))
        return real(ptr, idx, val, y, n, **kw)

    real = learn.sparse_logreg
    monkeypatch.setattr(learn, "sparse_logreg", noted)
    m = toxicity.fit(texts, y)
    (ptr, idx, val, n, kw), = seen
    assert idx.dtype == np.int32 and len(idx) == ptr[-1] and len(val) == n < len(idx) and (val[idx] != 0).all()
    assert all(len(np.unique(idx[a:b])) == b - a for a, b in zip(ptr, ptr[1:]))
    w, b = real(ptr, idx, val[idx], y, n, **{**kw, "by_feature": False})
    w2, b2 = real(ptr, idx, val, y, n, **kw)
    assert b == b2 == m.bias and (w == w2).all()
    data = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in data])))
    assert ((toxicity.margins(m, np.frombuffer(b"".join(data), np.uint8), off) > 0) == (y == 1)).all()


def test_labelled_sample_is_bounded(spark, docs_of):
    d = docs_of([(i, "b" * 50 if i == 7 else f"text {i}") for i in range(40)] + [(7, "a" * 50)] * 500)
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, None)], "doc_id long, toxic int")
    texts, y, _ = learn.labelled_sample(d, lab, "toxic", 5, 0, max_chars=20)
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert texts == ["a" * 20 if i == 7 else f"text {i}" for i in kept] and y.tolist() == [i % 2 for i in kept]


HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_secrets(docs_of, awkward):
    texts = {100: f'some words token = "{HEX}" and more', 101: "call card 4539578763621486 today",
             102: f"fixed in commit {HEX} by them", 103: f'é é password="Zx81kQpV02mNwq77" {HEX[:12]}',
             104: f'token = "{HEX}" x token = "{HEX}"'}
    d = docs_of([*texts.items(), *awkward], extra=True)
    out = secrets.scan(d).collect()
    hit = {(r.doc_id, r.value) for r in out if r.is_secret}
    assert {(100, HEX), (103, "Zx81kQpV02mNwq77"), (104, HEX)} <= hit
    assert not {i for i, _ in hit} & {101, 102}
    for r in out:
        if r.doc_id and r.doc_id >= 100:
            assert texts[r.doc_id][r.start:r.start + r.length] == r.value
    red = {r.doc_id: r for r in secrets.redact(d).collect() if r.doc_id and r.doc_id >= 100}
    assert HEX not in red[104].text and red[104].text.count("[SECRET]") == 2
    assert red[104].n_chars == len(red[104].text) and red[101].text == texts[101]
    assert secrets.redact(d).count() == d.count() and secrets.redact(d).columns == d.columns
    assert secrets.scan(docs_of({})).count() == 0


FORMS = {200: ('password = "{}"', "P@ssw0rd!2024#x"), 201: ('password = "{}"', "correct-horse-battery"),
         202: ('api_key = "{}"', "kqWmZxTbRvNpLsYdHfGcJe"), 203: ("log in with pw: {} and go", "s3cr3t!"),
         204: ("connect to postgres://app:{}@db/x first", "Tr0ub4dor"), 205: ('secret_key_v2_prod = "{}"', "Zx81kQpV02mNwq77"),
         206: ("key\n{}\nend", "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\nlQOYBFabc/def+ghi\nabcdefgh\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----"),
         207: ("key\n{}\nend", "-----BEGIN RSA PRIVATE KEY-----\nDEK-Info: AES-128-CBC,00\n\nMIIEowIBAAKCAQEA\nabcdefghijkl\n-----END RSA PRIVATE KEY-----")}


def test_secret_forms(docs_of):
    plain = {300: "the password: required by them", 301: "token = null", 302: "password = ${DB_PASSWORD}", 303: "Author: John Smith", 304: "auth: the next page"}
    texts = {i: "é some words " + form.format(v) for i, (form, v) in FORMS.items()} | plain
    d = docs_of(texts)
    out = secrets.scan(d).collect()
    assert all(texts[r.doc_id][r.start:r.start + r.length] == r.value for r in out)
    assert {(i, v) for i, (_, v) in FORMS.items()} <= {(r.doc_id, r.value) for r in out if r.is_secret}
    assert not [r for r in out if r.is_secret and r.doc_id >= 300]
    red = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert red == {i: "é some words " + form.format("[SECRET]") for i, (form, _) in FORMS.items()} | plain


def test_secret_neighbours_are_cut_by_position(docs_of):
    text = "abcdefghijkl1 mnopqrstuvwx2 pw: x, token=y secret_key_v2_prod = 'Zx81kQpV02mNwq77' abcdefghijkl3 end"
    c = secrets.candidates(docs_of({1: text})).collect()
    assert {r.value for r in c} == {"abcdefghijkl1", "mnopqrstuvwx2", "x", "y", "Zx81kQpV02mNwq77", "abcdefghijkl3"}
    for r in c:
        end = r.start + len(r.value)
        assert text[r.start:end] == r.value
        assert r.before == text[max(0, r.start - secrets.CONTEXT):r.start] and r.after == text[end:end + secrets.CONTEXT]
