import shutil

import corpus_pipeline as p
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import DATA
from test_decontaminate import brute as leaks
from test_near_dedup import brute as groups
from test_suffix_dedup import brute as repeats

from docketry.llm.quality_rules import measure


def table_of(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def test_each_stage_against_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    at = []
    for name, stage in p.STAGES:
        at.append(docs)
        docs = p.staged(stage(spark, docs, DATA), "test")
        assert name == "piece encoding" or docs.columns == columns
    at = [table_of(x) for x in [*at, docs]]

    def good(text):
        m = measure(text or "")
        return m[0] >= 50 and 100 * m[4] <= 50 * m[0]

    # So few labels prove no cutoff; the base rule holds.
    assert at[1] == {i: r for i, r in at[0].items() if good(r["text"])}
    rows = [(i, r["text"]) for i, r in at[1].items()]
    assert at[2].keys() == {r[0] for r in groups(rows, words=5) if r[3]}
    order = list(at[2])
    gone = repeats([at[2][i]["text"].encode() for i in order], 200)
    assert at[3].keys() == at[2].keys()
    for i, g in zip(order, gone):
        lost = len(at[2][i]["text"].encode()) - len(at[3][i]["text"].encode())
        assert g[1] - 6 * g[2] <= lost <= g[1] and at[3][i]["n_chars"] == len(at[3][i]["text"])
    items = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    held = {i for i, _ in leaks([(i, r["text"]) for i, r in at[3].items()], list(zip(items["item_id"], items["text"])))}
    assert held and at[4].keys() == at[3].keys() - held
    assert at[5].keys() == at[4].keys() and all(r["restored"] for r in at[5].values())
    assert sorted(r["ids_crc32"] for r in p.run(spark, DATA).collect()) == sorted(r["ids_crc32"] for r in at[5].values())


def test_odd_rows_go_through(spark, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (None, None), (4, None), (5, ""), (6, text.upper()), (7, " ".join(f"é{i}" for i in range(90)))]
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("kept", pa.int32()), ("spans", pa.string())])
    data = [dict(zip(kinds.names, (i, t, None, None, None, 3, "x"))) for i, t in rows]
    pq.write_table(pa.Table.from_pylist(data, kinds), tmp_path / "documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, 1, 7]
    pq.write_table(pa.Table.from_pylist([], kinds), tmp_path / "documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
