from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestary.functions import html
from attestary.operators import problems, value
from attestary.plans import catalog
from attestary.sources import records
from attestary.streaming import feeds


def _as_its_sql(spark, name, folder):
    """The query's rows and its SQL's, over Parquet files of a folder."""
    got = catalog.QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    for path in folder.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    return sorted(map(tuple, got.select(columns).collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", ["verify_quotes_plain", "advantage_check", "candidate_verified"])
def test_plain_quotes_stand_character_by_character(spark, tmp_path, name):
    items = [(0, "One sentence of the benchmark."), (0, "One sentence of the benchmark."), (1, "And its last sentence, which is long.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    forms = [lambda t: f"x {t} y", str.upper, lambda t: t.replace(" ", "  "), lambda t: t.rstrip(".") + "!", lambda t: f"x{t}y", lambda t: "other", lambda t: ""]
    docs = [(i, f(items[i % 3][1])) for k, f in enumerate(forms) for i in range(12 * k, 12 * k + 12)] + [(96, None), (98, None), (98, None), (4, "other"), (4, "other")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = _as_its_sql(spark, name, tmp_path)
    assert got == want and len(got) == len(docs)


def test_large_profiles_have_digests_too(spark, tmp_path):
    rows = "SELECT id AS doc_id, repeat(concat('word ', id, ' '), 2500) AS text, 's' AS source FROM range(95, 115)"
    spark.sql(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = _as_its_sql(spark, "profile_digest", tmp_path)
    assert got == want and len(got) == 2 and all(digest for _, digest, _ in got) and max(chars for chars, *_ in got) > 200_000


@pytest.mark.parametrize("name", ["page_region", "pages_without_region", "visible_text", "items_from_sections", "discover_feeds"])
def test_pages_are_read_once_by_many_tasks(spark, name):
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Repartition")
    assert rows.select(F.spark_partition_id().alias("part")).distinct().count() > 1


def test_a_helper_holds_few_pages():
    pages = [("x" * n,) for n in [10] * 3000 + [10**6, 10**6, 5]]
    parts = list(html._few(iter(pages)))
    assert [p for part in parts for p in part] == pages and len(parts) == 5 and max(map(len, parts)) <= 1024


def test_record_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1"}')
    for rows in records.read_records(spark, str(tmp_path), "id string", ("id",)):
        assert "ArrowEvalPython" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_source_sets_one_timer_for_many_scans():
    kept, timers = {"life": None, "waiting": []}, []
    life = SimpleNamespace(exists=lambda: kept["life"] is not None, get=lambda: kept["life"], update=lambda x: kept.update(life=x))
    waiting = SimpleNamespace(get=lambda: iter(kept["waiting"]), appendList=lambda x: kept["waiting"].extend(x), put=lambda x: kept.update(waiting=x), clear=lambda: kept.update(waiting=[]))
    source = feeds.SourceLife(3, 5, 3)
    source.init(SimpleNamespace(getValueState=lambda *_: life, getListState=lambda *_: waiting, registerTimer=timers.append))
    at = pd.to_datetime(pd.Series(range(1000)), unit="s").astype("datetime64[us]")
    rows = pd.DataFrame({"seq": range(1000), "ts": at, "outcome": "new", "status": "candidate", "cadence": 24})
    assert list(source.handleInputRows(("a",), iter([rows]), None)) == [] and timers == [0]
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    (first,) = source.handleExpiredTimer(("a",), now(499_500), None)
    assert first.values.tolist() == [["a", 4, "candidate", "retired", "no yield", 5, 0, 0, 5]] and timers == [0, 500_000]
    assert list(source.handleExpiredTimer(("a",), now(10**9), None)) == [] and kept["life"][1] == 999 and not kept["waiting"] and len(timers) == 2


def test_a_shortlist_writes_no_pairs_and_meets_alike_texts_once(spark, monkeypatch):
    written, staged = {}, problems.staged
    monkeypatch.setattr(problems, "staged", lambda rows, what, by=None: written.setdefault(what, staged(rows, what, by)))
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id < 290, concat('robot planning ', 1000 + id), 'robot arm') AS text")
    asked = spark.range(200).selectExpr("id AS query_id", "if(id < 190, concat('planning robot ', 5000 + id), 'robot arm arm') AS text")
    found = problems.shortlist(asked, docs, k=2)
    near = {(r.query_id, r["rank"]): r.doc_id for r in found.collect()}
    assert near == {(q, n): (0 if q < 190 else 290) + n - 1 for q in range(200) for n in (1, 2)}
    ids = lambda side: sorted(x for r in written[f"{side}-blocks"].collect() for x in r[side])
    assert ids("doc_id") == [0, 1, 290, 291] and ids("query_id") == [0, 190]
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_factors_of_a_value_are_aggregated_once(spark):
    rows = [(p, q, float(i + 1), float(i + 2), "supported") for p in "ab" for i, q in enumerate(value.MODELS["incident"])] + [("c", "buyer_count", None, 2.0, "supported")]
    out = value.potential_value(spark.createDataFrame(rows[1:], "problem_id string, quantity string, low double, high double, status string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {r.problem_id: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (None,) * 4, "b": (24.0, 120.0, "supported", "incident"), "c": (None,) * 4}


def test_listing_pages_are_read_by_many_tasks(spark):
    plan = catalog.QUERIES["listing_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Repartition")


def test_plainly_spelled_tables_are_read_without_a_tree(spark, monkeypatch):
    row = '<tr data-rank="{0}" title="r"><td class="num">{0}</td><td><b title="Baseline">Base&amp;line</b> team-{0}</td><td><span class="x fw-bold">B <a href="u">c</a></span> 0.5</td></tr>'
    plain = "<html><body><p>x</p><table><thead><tr><th>#</th></tr></thead>" + "".join(map(row.format, range(3))) + "</table><table><tr><td>2</td></tr></table>"
    others = [plain.replace("</td><td>", "<td>"), plain.replace("</tr>", ""), plain.replace('"num"', "num"), "<!-- " + plain + " -->" + plain, "<script>" + plain,
              plain.replace("team", "<script><td></script>"), plain.replace("team", "<table><tr><td>t</table>"), plain[:200], "", None]
    want = html._parsed_rows(plain)
    assert [html.table_rows(x) for x in others] == [html._parsed_rows(x) for x in others]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([plain, *others])], "k int, html string").select("k", html.table_column(F.col("html")).alias("r"))
    assert [[c.asDict(True) for c in x.r] for x in rows.orderBy("k").collect()] == [html._parsed_rows(x) for x in [plain, *others]]
    monkeypatch.setattr(html, "tree", None)
    assert html.table_rows(plain) == want and len(want) == 4 and want[1]["cells"][2]["bold"] == "B c"


def test_a_batch_writes_one_part_that_takes_earlier_ones_in(spark, tmp_path):
    folder = f"{tmp_path}/items"
    for n in range(4):
        rows = [(f"https://a.example/{k}", "s", "t", f"text {k} {n if k == n else ''}", False, 1) for k in (n, n + 1)]
        spark.createDataFrame(rows, "url string, source_id string, title string, text string, finished boolean, at int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        raw = spark.readStream.schema("url string, source_id string, title string, text string, finished boolean, at int").parquet(f"{tmp_path}/in/*")
        feeds.upsert_stream(raw, folder, f"{tmp_path}/c").awaitTermination()
        assert sorted(p.name for p in (tmp_path / "items").iterdir()) == [*(f"batch={k}" for k in range(n + 1)), "manifest"]
    assert feeds.live_parts(spark, folder) == [(0, 3)]
    got = {r.url[-1]: (r.revision, r.first_seen.timestamp(), r.last_seen.timestamp()) for r in feeds.current_items(spark, folder).collect()}
    assert {k: (r, b - a) for k, (r, a, b) in got.items()} == {"0": (1, 0.0), "1": (2, 1.0), "2": (2, 1.0), "3": (2, 1.0), "4": (1, 0.0)}
    files = list((tmp_path / "items" / "batch=3").rglob("part-*"))
    assert spark.read.parquet(f"{folder}/batch=3").count() == 5 and len(files) >= 1


def test_few_strings_of_a_batch_are_python_s_at_once():
    made = []

    class Value:
        def as_py(self):
            made.append(1)
            return "x" * 100

    pieces = html.in_few(str.upper, html.pa.string(), iter([[Value() for _ in range(10_000)]]))
    assert next(pieces)[0].as_py() == "X" * 100 and len(made) <= html._ROWS_AT_ONCE
    assert sum(map(len, pieces)) == 10_000 - html._ROWS_AT_ONCE


def test_every_line_of_a_page_is_a_quote(spark, tmp_path):
    page = "<html><head><title>{0}</title></head><body>{1}</body></html>"
    texts = {"a": ["the first line of it", "short", "and the last line of it"], "b": ["Title of page a", "quite another line, alone"], "c": ["nothing else is here"]}
    pages = [(k, f"https://p.example/{u}", page.format(f"Title of page {u}", "".join(f"<p>{x}</p>" for x in lines))) for k, (u, lines) in zip((3, 40, 500), texts.items())]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.url[-1], r.quote, r.status) for r in catalog.QUERIES["verify_quotes"](spark, str(tmp_path)).collect())
    lines = [(u, x, "quote_too_short" if x == "short" else "verified") for u in texts for x in texts[u]]
    own = [(u, f"Title of page {u}", "quote_not_found") for u in texts]
    assert got == sorted([*lines, *own, ("b", "Title of page a", "verified"), ("c", "Title of page b", "quote_not_found")])


def test_advantages_rest_on_quotes_in_normal_form_and_on_self_ratings(spark, tmp_path):
    items = [(0, "„Große“ words — of a quote."), (1, "Two words"), (2, "**Level** of skill: 9!"), (3, "it costs $40.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(4, 'so "GROSSE"  words - of a `quote`, it said'), (5, "two words"), (10, "level of skill : 9 and more"), (11, "It costs $40, as\nsaid"), (15, "it costs $400"), (21, "Two words"),
            (22, "level of\nskill: 9"), (26, "level of skills: 9"), (44, "„Große“ words — of a quote."), (45, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = _as_its_sql(spark, "advantage_check", tmp_path)
    assert got == want
    missing = {5: "quote too short", 15: "quote not found", 21: "not a profile file", 26: "quote not found", 45: "quote too short"}
    assert {doc: (basis, why) for basis, doc, _, why in got} == {doc: (None, missing[doc]) if doc in missing else ("self_rating" if doc % 11 == 0 else "profile", None) for doc, _ in docs}


def test_a_tile_scores_few_pairs_in_full(monkeypatch):
    rng, in_full, exact = np.random.default_rng(5), [], problems._Queries._exact
    monkeypatch.setattr(problems._Queries, "_exact", lambda self, i, docs, *x: in_full.extend(docs) or exact(self, i, docs, *x))
    idf, idf_q = rng.uniform(2, 9, 400), rng.uniform(0.9, 0.999, 400)
    idf_q = idf * idf_q
    n = lambda rows: rng.poisson(0.5 / np.arange(1, 401) ** 0.4, (rows, 400)) * (rng.random((rows, 1)) < 0.98)
    asked, docs = n(150), n(900)
    docs[700], docs[800] = docs[3], docs[3]  # ties
    asked, docs = asked[asked.any(1)], docs[docs.any(1)]

    def block(counts, prefix, **values):
        at, word = np.nonzero(counts)
        order = np.argsort(word, kind="stable")
        return {f"{prefix}at": at[order].astype("i4"), f"{prefix}word": word[order]} | {f"{prefix}{k}": v(counts[at, word], word)[order] for k, v in values.items()}

    q = block(asked, "q_", a=lambda n, w: n * idf_q[w] ** 2, b=lambda n, w: idf_q[w] ** 2 - idf[w] ** 2) | {"q_norm": ((asked * idf_q) ** 2).sum(1)}
    norm = ((docs * idf) ** 2).sum(1)
    more = (asked > 0) @ (docs**2 * (idf_q**2 - idf**2)).T
    want = np.round((asked * idf_q**2) @ docs.T / np.sqrt(q["q_norm"][:, None] * (norm + more)), 12)
    for common in (0, 0.05, 2):
        tile, found = problems._Queries(3, common, q), {i: [] for i in range(len(asked))}
        in_full.clear()
        for part in (slice(0, 500), slice(500, 900)):
            rows = block(docs[part], "", a=lambda n, w: n.astype("i4")) | {"norm": norm[part]}
            for i, d, score in zip(*tile.meet(rows)):
                found[i].append((-score, d + part.start))
        for i, own in enumerate(want):
            best = sorted((-s, d) for d, s in enumerate(own) if s > 0)[:3]
            assert [d for _, d in sorted(found[i])[:3]] == [d for _, d in best] and np.allclose([s for s, _ in sorted(found[i])[:3]], [s for s, _ in best], rtol=0, atol=2e-12)
        assert len(in_full) < want.size / 10


def test_words_of_repeated_keys_are_added_up(spark):
    rows = [(1, "The Robot robot is at 42x7"), (2, None), (3, "an"), (1, "ROBOT-arm"), (4, "ßé naïve")]
    got = sorted(map(tuple, problems.terms(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()))
    assert got == [(1, "42x7", 1), (1, "arm", 1), (1, "robot", 3)]
    assert sorted(map(tuple, problems.terms(spark.createDataFrame(rows[:2], "id long, text string"), "id", "text").collect())) == [(1, "42x7", 1), (1, "robot", 2)]
