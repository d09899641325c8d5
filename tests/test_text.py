import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldlake.functions import taxonomy as X
from fieldlake.functions import text as T
from fieldlake.functions.embedding import hash_embed


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*columns).first()


def plain_clean(value):
    t = unicodedata.normalize("NFKC", value or "")
    for pattern in (T.SCRIPT, T.STYLE, T.TAG):
        t = re.sub(pattern, " ", t)
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", html.unescape(t))
    t = re.sub(r"[ \t\f\v]+", " ", t.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@pytest.mark.parametrize("value", [
    "<p>Hello&nbsp;<b>World</b></p>\n\n\n\n<script>x()</script> ok", "a\r\nb\rc", "ﬁne \x07 text　", "", None,
    "<STYLE>p{}</STYLE>x &lt;tag&gt; &amp;amp; y", "  tab\t\tand \x0b vt ", "कापूस &#2325; ok", "a < b > c", "no change",
])
def test_clean_text_equals_plain_python(spark, value):
    assert one(spark, value, T.clean_text(F.col("t")))[0] == plain_clean(value)


def test_clean_nested_values(spark):
    df = spark.sql("""select named_struct('a', '<b>x</b>', 'l', array('<i>y</i>', null), 's', array(named_struct('q', ' z ', 'n', 1)),
                      'm', map('k', '<u>v</u>'), 'n', 5) as r""")
    r = T.clean_columns(df).first()["r"]
    assert r["a"] == "x" and r["l"] == ["y", None] and r["n"] == 5
    assert r["s"][0]["q"] == "z" and r["s"][0]["n"] == 1 and r["m"] == {"k": "v"}


@pytest.mark.parametrize("value,tag", [
    ("How to grow cotton?", "en"), ("कापूस पीक आहे आणि पाणी", "mr"), ("यह फसल है और पानी के लिए", "hi"), ("कापूस", "mr"),
    ("cotton कापूस पीक", "mixed"), ("12345", "unknown"), ("  ", "unknown"), (None, "unknown"),
    ("कापूस " * 10 + "ab", "mr"),
])
def test_language(spark, value, tag):
    assert one(spark, value, T.detect_language(F.col("t")))[0] == tag


@pytest.mark.parametrize("a,b,tag", [
    ("en", "en", "en"), ("unknown", "en", "en"), ("mr", "unknown", "mr"), ("unknown", "mixed", "mixed"), ("en", "mr", "mixed"),
    ("hi", "mr", "mixed"), ("mixed", "en", "mixed"), ("unknown", "unknown", "unknown"),
])
def test_language_pairs(spark, a, b, tag):
    assert one(spark, "x", T.combine_languages(F.lit(a), F.lit(b)))[0] == tag


def test_split_is_md5_modulo(spark):
    import hashlib

    keys = [f"key {i}" for i in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.assign_split(F.col("k")).alias("s")).collect()
    for r in got:
        n = int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 100
        assert r["s"] == ("train" if n < 80 else "val" if n < 90 else "test")


def test_capitalize(spark):
    assert one(spark, "pUNE cITY", T.capitalize(F.col("t")))[0] == "Pune city"


@pytest.mark.parametrize("value,crop", [
    ("kapas", "Cotton"), (" Tur ", "Tur (Pigeon Pea)"), ("grow red gram now", "Tur (Pigeon Pea)"), ("us", "Sugarcane"),
    ("you must", None), ("a program", "Gram (Chickpea)"), ("डाळिंब बाग", "Pomegranate"), ("", None), ("Orange (Nagpur Santra)", "Orange (Nagpur Santra)"),
])
def test_resolve_crop(spark, value, crop):
    assert one(spark, value, X.resolve_crop(F.col("t")))[0] == crop


def test_extract_crops_in_text_order(spark):
    row = one(spark, "Onion after cotton, you must see डाळिंब", X.extract_crops(F.col("t")))
    assert row[0] == ["Onion", "Cotton", "Sugarcane", "Pomegranate"]
    assert one(spark, "nothing here", X.extract_crops(F.col("t")))[0] == []


def test_categories_districts_units(spark):
    row = one(spark, "Soil pH and drip", X.detect_categories(F.col("t")))
    assert row[0] == ["soil", "irrigation"]
    assert one(spark, "zzz", X.detect_categories(F.col("t")))[0] == ["general"]
    d = one(spark, "near Nasik city", X.resolve_district(F.col("t")))[0]
    assert (d["district"], d["zone"], d["state_id"]) == ("Nashik", "Western Ghat / Transition", "MH")
    assert one(spark, "Satara", X.resolve_district(F.col("t")))[0] is None
    assert one(spark, "°C", X.normalize_unit(F.col("t")))[0] == "C"
    assert one(spark, "Quintal", X.convert_mass(F.lit(2.0), F.col("t"), F.lit("kg")))[0] == 200.0
    assert one(spark, "stone", X.convert_mass(F.lit(2.0), F.col("t"), F.lit("kg")))[0] is None
    assert one(spark, "acre", X.convert_area(F.lit(1.0), F.col("t"), F.lit("ha")))[0] == pytest.approx(0.404686)


def test_list_key_beats_domain(spark):
    assert one(spark, "x", X.record_category(F.lit("markets"), F.lit("soil")))[0] == "market"
    assert one(spark, "x", X.record_category(F.lit("records"), F.lit("soil")))[0] == "soil"
    assert one(spark, "x", X.record_category(F.lit("records"), F.lit("odd")))[0] == "general"


def test_hash_embedding(spark):
    import hashlib

    import numpy as np

    text = "Cotton pest बोंड अळी cotton"
    vec = np.array(one(spark, text, hash_embed(F.col("t")))[0])
    want = np.zeros(384)
    low = text.lower()
    words = re.findall(r"[\wऀ-ॿ]+", low)
    compact = re.sub(r"\s+", "", low)
    feats = [(w, hashlib.md5, 1.0) for w in words] + [(f"{a}_{b}", hashlib.md5, 0.5) for a, b in zip(words, words[1:])]
    feats += [(compact[i:i + 3], hashlib.sha1, 0.25) for i in range(len(compact) - 2)]
    for f, digest, w in feats:
        h = int(digest(f.encode()).hexdigest(), 16)
        want[h % 384] += w if (h // 384) % 2 == 0 else -w
    assert np.allclose(vec, want / np.linalg.norm(want), atol=1e-6)
    assert not any(one(spark, "", hash_embed(F.col("t")))[0])


def test_hash_embedding_of_many_texts(monkeypatch):
    import hashlib

    import numpy as np

    from fieldlake.functions import embedding

    calls = []
    for name in ("md5", "sha1"):
        monkeypatch.setattr(embedding.hashlib, name, lambda b, made=getattr(hashlib, name): (calls.append(b), made(b))[1])
    texts = ["Cotton pest cotton", "", "a", "É\u2028x\x1c y\x85z", "बोंड अळी", "a_b a b", "😀a😀b"] * 3
    got = embedding.embed(texts)
    hashed = len(calls)
    for t, vec in zip(texts, got, strict=True):
        assert np.array_equal(vec, embedding.embed([t])[0])  # texts beside it change nothing
    calls.clear()
    embedding.embed(texts[:7])
    assert hashed == len(calls)  # texts that repeat are not hashed again
    assert got.shape == (21, 384) and np.allclose(np.linalg.norm(got, axis=1), [float(t != "") for t in texts])
