"""The wide table of virtual users over all songs."""

from playlens.operators import groups, indexing
from playlens.plans import queries as q
from tests.conftest import SF_SMALL


def test_blocks_hold_every_cell(spark):
    rows = [(g, i, float(g * 100 + i)) for g in range(5) for i in range(g, 40, g + 3)]
    virtual = spark.createDataFrame(rows, "group_id long, item_id long, score double")
    index = indexing.index_ids(spark.range(40))
    got = groups.virtual_user_blocks(virtual, index, 8).collect()
    assert all(len(r["scores"]) == 8 for r in got)
    assert len({(r["group_id"], r["block"]) for r in got}) == len(got) == len({(g, i // 8) for g, i, _ in rows})
    cells = {(r["group_id"], r["block"] * 8 + k): s for r in got for k, s in enumerate(r["scores"]) if s}
    assert cells == {(g, i): s for g, i, s in rows if s}


def test_registered_table_loses_no_song(spark):
    long = {(r["group_id"], r["item_id"]): r["score"] for r in q.QUERIES["virtual_users"](spark, SF_SMALL).collect() if r["score"]}
    songs = {r["idx"]: r["id"] for r in q.QUERIES["id_index_items"](spark, SF_SMALL).collect()}
    wide = q.QUERIES["virtual_user_blocks"](spark, SF_SMALL).collect()
    assert len(songs) > 20
    assert {(r["group_id"], songs[r["block"] * 1024 + k]): s for r in wide for k, s in enumerate(r["scores"]) if s} == long
