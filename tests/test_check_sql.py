"""Check queries state the same rule as their queries, also on rows the given tables lack."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Sorted rows of a registered query and of its check query over the same small tables."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = entry.queries()[name](spark, str(folder))
    columns = ", ".join(got.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)


PAGES = ["a &amp b &ampx &notit; &lt;i&gt; &eacute;&#233;&#x80;&#0;&#xD800;&#x110000; &bogus; & &am", "ﬁn ½ é Å …", "<p>x</p>\x0b\x0by \r\n\r\n\r\nz",
         "&NotEqualTilde;&#65;&#x41", "&amp;quot; &quot", ""]


def pages():
    return pa.table({"page_id": list(range(len(PAGES))), "url": [f"https://h/{i}" for i in range(len(PAGES))], "html": PAGES})


def test_html_clean_decodes_all_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_html_clean", pages=pages())
    assert got == want and len(got) == len(PAGES)


def test_clean_stage_decodes_all_references(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_clean_stage", pages=pages())
    assert got == want and len(got) == len(PAGES)


def test_fertilizer_rounds_half_even(spark, tmp_path):
    balances = [6.25, 10000 / 40 + 31.25, 281.25, 9010.0, 2.07, -1875.5, 0.0, 4999.99, 123.45]
    n = len(balances)
    customer = pa.table({"c_custkey": list(range(n)), "c_mktsegment": ["BUILDING", "AUTOMOBILE", "MACHINERY"] * (n // 3), "c_nationkey": [12] * n, "c_acctbal": balances})
    got, want = both(spark, tmp_path, "q_fertilizer", customer=customer)
    assert got == want and len(got) == n


def test_stream_windows_round_ties_alike(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(minutes=i * (u + 1) % 1400), 40 + ((i * 7 + u) % 100) / 100 + (i == 0) * (1 + 2 * u) / 100) for u in range(40) for i in range(32)]
    rows += [(99, start, float("nan")), (99, start, 50.0), (98, start, None), (0, start + dt.timedelta(days=9), 1.0)]
    events = pa.table({"event_id": list(range(len(rows))), "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "user_id": [r[0] for r in rows],
                       "value": [r[2] for r in rows]})
    got, want = both(spark, tmp_path, "q_stream_windows", events=events)
    assert got == want and len(got) == 82


def test_scheme_search_sends_each_word_only_its_first_items(spark, tmp_path, monkeypatch):
    from fieldlake.operators import queryplan

    seen = []
    write = queryplan.materialize
    monkeypatch.setattr(queryplan, "materialize", lambda df, label: seen.append(write(df, label)) or seen[-1])
    part = pa.table({"p_partkey": list(range(90)), "p_name": [["ring", "gear", "ring gear", "bolt"][i % 4] for i in range(90)], "p_type": ["building" if i % 7 == 0 else "x" for i in range(90)],
                     "p_brand": ["b"] * 90})
    customer = pa.table({"c_custkey": list(range(40)), "c_mktsegment": ["BUILDING", "AUTOMOBILE"] * 20, "c_nationkey": [i % 25 for i in range(40)]})
    got, want = both(spark, tmp_path, "q_scheme_search", part=part, customer=customer)
    assert got == want and len(got) == 40 * 8 - 3 * 3 * 2
    assert seen[0].count() <= 3 * 8


def test_scheme_search_answers_each_list_of_words_and_searches_each_blob_once(spark, tmp_path, monkeypatch):
    from fieldlake.operators import queryplan, retrieval

    seen = {}
    for module in (queryplan, retrieval):
        monkeypatch.setattr(module, "materialize", lambda df, label, write=module.materialize: seen.setdefault(label, write(df, label)))
    part = pa.table({"p_partkey": list(range(200)), "p_name": [["ring", "gear", "bolt"][i % 3] for i in range(200)], "p_type": ["x"] * 200, "p_brand": ["b"] * 200})
    customer = pa.table({"c_custkey": [*range(150), 7, 7], "c_mktsegment": ["BUILDING", "AUTOMOBILE", "RING"] * 50 + ["BUILDING", "RING"], "c_nationkey": [4 + i % 20 for i in range(150)] + [5, 14]})
    got, want = both(spark, tmp_path, "q_scheme_search", part=part, customer=customer)
    assert got == want and len(got) == 150 * 8
    assert seen["list-items"].count() <= 3 * 2 + 1
    assert {r["_g"] for r in seen["needle-grams"].collect()} == {"rin", "ing", "gea", "ear"}  # only grams of words, of three blobs
    assert seen["needle-grams"].count() == 4
