import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import html, neighbours, secrets


def test_neighbours_over_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 16)  # 375 lists
    x = np.random.default_rng(11).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(rows, F.col("id") % 60 == 0).collect()}
    want = set()
    for q in range(0, 6000, 60):
        score = x @ x[q]
        score[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-score)[:20]}
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


def test_secrets_inside_longer_runs(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    made = ["".join(rng.choice(letters, 20)) for _ in range(10)]
    names = ("", "storage_connection_key=", "service_account_private_key=", "api/v1/service/account/session/user/profile/")
    texts = [f"é {n}{s} end" for n in names for s in made]
    cut = "é " + "q8Zt4Lw0Xv3Rk7Jp2Hn6Bd1Ys5Gf9Mc" + "_password=abcdef and get_user_account_balance_from_remote_server/config/session/user/profile"
    docs = spark.createDataFrame(list(enumerate([*texts, cut])), "doc_id long, text string")
    model = secrets.train(secrets.labelled_samples(docs))
    found = {r.doc_id: r.spans for r in secrets.scan(docs, model).collect()}
    assert all(found[i] == f"markov:2:{len(t) - 4}" for i, t in enumerate(texts))
    assert found[len(texts)] == "markov:2:34,assign:34:49"


def test_main_text_inside_layout_wrappers():
    body = " ".join(f"word{i}" for i in range(40)) + "."
    page = f"<nav><a>Home</a></nav>{{}}<h1>Title</h1><p>{body}</p><p>{body}</p>{{}}<footer>Legal</footer>"
    plain, whole = html.main_text(page.format("", "")), f"Title\n{body}\n{body}"
    assert body in plain
    for tag in ('div class="layout has-sidebar"', 'div class="content with-sidebar"', 'div class="post no-comments"', 'div class="widget"', "form action=x"):
        end = f"</{tag.split()[0]}>"
        assert html.main_text(page.format(f"<{tag}>", end)) == plain
        for main in ("article", "main"):
            assert html.main_text(page.format(f"<{tag}><{main}>", f"</{main}>{end}")) == whole
    comments = f"<section id=comments><article class=comment><p>{body} {body} {body} {body}</p></article></section>"
    assert html.main_text(page.format("<article>", "</article>" + comments)) == whole


def test_decontamination_stage_decides_by_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"item{k}" for k in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {item} z"), (None, "clean without id"), (5, f"b {item} z"), (5, "clean with the same id"), (6, None), (7, "clean"), (7, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
