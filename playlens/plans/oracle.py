"""DuckDB SQL checks, one per query in ``plans.queries`` where SQL can say it.

Every statement starts from the raw test tables (views named after them) and
rebuilds the same fixtures with CTEs. Double columns are rounded to 6 places,
as the Spark side does. Queries left out here (ALS, file listing) get a
rows-only check.
"""

from __future__ import annotations

from playlens.operators.catalogue import RAGGED_FIELDS
from playlens.sources.fixtures import OFFSETS, ROW_ARRAYS, SCALARS, TEXT_ARRAYS, first_value

PLAYS = """plays AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(sum(l_quantity) AS INTEGER) AS play_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey)"""


def _stats(name: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key} AS id, CAST(sum(play_count) AS BIGINT) AS total_play, count(*) AS occurrence,
         CAST(sum(play_count) AS DOUBLE) / count(*) AS mean
  FROM plays GROUP BY {key})"""


USER_STATS = _stats("user_stats", "user_id")
ITEM_STATS = _stats("item_stats", "item_id")

SPLIT = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
                               ORDER BY md5(concat_ws(':', '42', user_id, item_id)), item_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM plays),
split AS (
  SELECT user_id, item_id, play_count,
         CASE WHEN rn <= round_even(0.5 * n, 0) THEN 'train' ELSE 'test' END AS split
  FROM ranked)"""


def _membership(g: int = 4, name: str = "membership") -> str:
    return f"""{name} AS (
  SELECT CAST((row_number() OVER (ORDER BY md5(concat_ws(':', '42', user_id)), user_id) - 1) // {g} AS BIGINT)
           AS group_id, user_id
  FROM (SELECT DISTINCT user_id FROM plays))"""


MEMBERSHIP = _membership(4)
GROUP_PLAYS = """group_plays AS (
  SELECT m.group_id, s.split, s.user_id, s.item_id, s.play_count
  FROM split s JOIN membership m USING (user_id))"""

NORMALIZED_AVG = "exp(avg(CASE WHEN play_count > 0 THEN ln(play_count) + 1 END))"
VIRTUAL = f"""vtrain AS (
  SELECT group_id, item_id, coalesce({NORMALIZED_AVG}, 0.0) AS score
  FROM group_plays WHERE split = 'train' GROUP BY group_id, item_id),
vtest AS (
  SELECT group_id, item_id, coalesce({NORMALIZED_AVG}, 0.0) AS score
  FROM group_plays WHERE split = 'test' GROUP BY group_id, item_id),
labels AS (SELECT group_id AS entity, item_id FROM vtest WHERE score <> 0),
entities AS (SELECT DISTINCT group_id AS entity FROM membership)"""

GROUPS_BASE = ",\n".join([PLAYS, USER_STATS, ITEM_STATS, SPLIT, MEMBERSHIP, GROUP_PLAYS, VIRTUAL])


def _cosine_topk(weights: str, k: int, prefix: str) -> str:
    """CTEs {prefix}_cos (all nonzero i != j) and {prefix}_nb (top k) over weights(row, item_id, w)."""
    return f"""{prefix}_norm AS (SELECT item_id, sqrt(sum(w * w)) AS nrm FROM {weights} GROUP BY item_id),
{prefix}_x AS (
  SELECT w.row, w.item_id, w.w / n.nrm AS x FROM {weights} w JOIN {prefix}_norm n USING (item_id)
  WHERE n.nrm > 0),
{prefix}_cos AS (
  SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.x * b.x) AS sim
  FROM {prefix}_x a JOIN {prefix}_x b ON a.row = b.row AND a.item_id <> b.item_id
  GROUP BY a.item_id, b.item_id),
{prefix}_nb AS (
  SELECT * FROM (
    SELECT item_i, item_j, sim,
           CAST(row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS INTEGER) AS rank
    FROM {prefix}_cos WHERE sim > 0)
  WHERE rank <= {k})"""


KNN = GROUPS_BASE + """,
kw AS (SELECT group_id AS row, item_id, ln(score + 1) AS w FROM vtrain WHERE ln(score + 1) <> 0),
""" + _cosine_topk("kw", 50, "k") + """,
k_den AS (SELECT item_i, sum(sim) AS d FROM k_nb GROUP BY item_i),
k_sn AS (SELECT k_nb.item_i AS q, k_nb.item_j AS t, k_nb.sim / k_den.d AS y
         FROM k_nb JOIN k_den USING (item_i) WHERE k_den.d > 0),
k_score AS (
  SELECT w.row, s.q AS item_id, sum(w.w * s.y) AS score
  FROM kw w JOIN k_sn s ON w.item_id = s.t GROUP BY w.row, s.q),
k_pred AS (
  SELECT * FROM k_score sc
  WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM kw p WHERE p.row = sc.row AND p.item_id = sc.item_id)),
k_ranked AS (
  SELECT row, item_id, score,
         CAST(row_number() OVER (PARTITION BY row ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank
  FROM k_pred)"""


def _knn_recs(n: int) -> str:
    return f"SELECT row AS entity, rank, item_id FROM k_ranked WHERE rank <= {n}"


def _top_items(col: str, n: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY {col} DESC, id) AS INTEGER) AS rank, id AS item_id
  FROM (SELECT * FROM item_stats ORDER BY {col} DESC, id LIMIT {n})"""


def _popular_recs(n: int, entities: str = "entities", col: str = "occurrence") -> str:
    return f"""SELECT e.entity, t.rank, t.item_id FROM {entities} e, ({_top_items(col, n)}) t"""


def _random_recs(n: int, entities: str = "entities") -> str:
    return f"""SELECT e.entity, t.rank, t.item_id FROM {entities} e, (
  SELECT CAST(row_number() OVER (ORDER BY k, item_id) AS INTEGER) AS rank, item_id FROM (
    SELECT md5(concat_ws(':', '42', id)) AS k, id AS item_id FROM item_stats
    ORDER BY k, item_id
    LIMIT (SELECT least({n}, CAST(round_even(0.2 * count(*), 0) AS BIGINT)) FROM item_stats))) t"""


def _per_entity(recs: str, labels: str = "labels", keys: str = "entity", k: int = 10, ent: tuple[str, ...] = ("entity",)) -> str:
    """CTEs m_flag .. m_pe: per-entity metric parts for recs(keys..., rank, item_id)."""
    ent_join = " AND ".join(f"r.{e} = l.{e}" for e in ent)
    ent = ", ".join(ent)
    return f"""m_recs AS ({recs}),
m_lab AS (SELECT DISTINCT {ent}, item_id FROM {labels}),
m_flag AS (
  SELECT r.*, CASE WHEN l.item_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM m_recs r LEFT JOIN m_lab l ON {ent_join} AND r.item_id = l.item_id),
m_cum AS (
  SELECT *, sum(hit) OVER (PARTITION BY {keys} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM m_flag),
m_per AS (
  SELECT {keys}, count(*) AS n_recs, sum(hit) AS hits,
         sum(CASE WHEN hit = 1 THEN c / rank ELSE 0 END) AS ap_s,
         sum(CASE WHEN hit = 1 AND rank <= {k} THEN 1.0 / ln(rank + 1.0) ELSE 0 END) AS dcg,
         sum(CASE WHEN hit = 1 THEN rank - 1.0 ELSE 0 END) AS pos_s
  FROM m_cum GROUP BY {keys}),
m_nl AS (SELECT {ent}, count(*) AS n_labels FROM m_lab GROUP BY {ent}),
m_pe AS (
  SELECT p.*, coalesce(m_nl.n_labels, 0) AS n_labels FROM m_per p LEFT JOIN m_nl USING ({ent})),
m_ent AS (
  SELECT {keys}, n_recs, n_labels, CAST(hits AS BIGINT) AS hits,
         CAST(hits AS DOUBLE) / n_recs AS precision,
         CASE WHEN n_labels > 0 THEN CAST(hits AS DOUBLE) / n_labels END AS recall,
         CASE WHEN n_labels > 0 THEN ap_s / n_labels ELSE 0.0 END AS ap,
         CASE WHEN n_labels > 0 THEN dcg / list_sum(list_transform(range(1, least(n_labels, {k}) + 1),
                                                                    lambda i: 1.0 / ln(i + 1.0)))
              ELSE 0.0 END AS ndcg,
         CASE WHEN n_labels > 0 THEN (pos_s / n_recs * 100.0 + (n_labels - hits) * 100.0) / n_labels
              ELSE 0.0 END AS pr
  FROM m_pe)"""


def _summary(group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg,
       round(2 * avg(precision) * avg(recall) / nullif(avg(precision) + avg(recall), 0), 6) AS f1,
       round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(pr), 6) AS mpr
FROM m_ent{gb}"""


def _metrics(base: str, recs: str) -> str:
    return f"WITH {base},\n{_per_entity(recs)}\n{_summary()}"


def _sweep(base: str, recs: str) -> str:
    cut = f"""SELECT ns.n, r.entity, r.rank, r.item_id FROM ({recs}) r, (VALUES (20), (50), (200)) ns(n)
  WHERE r.rank <= ns.n"""
    return f"WITH {base},\n{_per_entity(cut, keys='n, entity')}\n{_summary('n')}"


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _round(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


CENTER_USER = """centred_u AS (
  SELECT p.user_id, p.item_id, p.play_count - s.mean AS score
  FROM plays p JOIN user_stats s ON p.user_id = s.id)"""
CENTER_ITEM = """centred_i AS (
  SELECT p.user_id, p.item_id, p.play_count - s.mean AS score
  FROM plays p JOIN item_stats s ON p.item_id = s.id)"""

SUBSET = """popular AS (SELECT id FROM item_stats WHERE occurrence > 30 AND mean > 25),
kept AS (SELECT user_id, item_id, play_count FROM plays
         WHERE play_count > 1 AND item_id IN (SELECT id FROM popular)),
active AS (SELECT user_id AS id FROM kept GROUP BY user_id HAVING count(*) > 8),
sub AS (SELECT * FROM kept WHERE user_id IN (SELECT id FROM active))"""

FOLDS = """franked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
                               ORDER BY md5(concat_ws(':', '42', user_id, item_id)), item_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM plays),
fb AS (
  SELECT *, round_even(n / 5.0, 0) AS e0 FROM franked),
fb1 AS (SELECT *, e0 + round_even((n - e0) / 4.0, 0) AS e1 FROM fb),
fb2 AS (SELECT *, e1 + round_even((n - e1) / 3.0, 0) AS e2 FROM fb1),
fb3 AS (SELECT *, e2 + round_even((n - e2) / 2.0, 0) AS e3 FROM fb2),
folded AS (
  SELECT user_id, item_id, play_count,
         CAST(CASE WHEN rn <= e0 THEN 0 WHEN rn <= e1 THEN 1 WHEN rn <= e2 THEN 2 WHEN rn <= e3 THEN 3
                   ELSE 4 END AS INTEGER) AS fold
  FROM fb3)"""

INDEX_USERS = """uidx AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS idx
             FROM (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey IS NOT NULL))"""
INDEX_ITEMS = """iidx AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS idx
             FROM (SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey IS NOT NULL))"""

HIST_EDGES = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5, 25.5, 50.5, 9967.5)


def _hist_sql() -> str:
    bins = ", ".join(f"({i}, {HIST_EDGES[i]}, {HIST_EDGES[i + 1]})" for i in range(len(HIST_EDGES) - 1))
    last = len(HIST_EDGES) - 2
    return _w(PLAYS) + f""", bins(bin, lo, hi) AS (VALUES {bins}),
binned AS (
  SELECT CASE WHEN play_count = {HIST_EDGES[-1]} THEN {last}
              ELSE (SELECT bin FROM bins WHERE play_count >= lo AND play_count < hi) END AS bin
  FROM plays),
tot AS (SELECT count(*) AS t FROM binned)
SELECT CAST(b.bin AS INTEGER) AS bin, CAST(b.lo AS DOUBLE) AS lo, CAST(b.hi AS DOUBLE) AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       round(coalesce(c.cnt, 0) / (SELECT t FROM tot) * 100.0, 6) AS pct
FROM bins b LEFT JOIN (SELECT bin, count(*) AS cnt FROM binned GROUP BY bin) c USING (bin)"""


DOC_TERMS = r"""words AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS term FROM documents),
tcounts AS (SELECT doc_id, term, count(*) AS cnt FROM words WHERE term <> '' GROUP BY doc_id, term),
terms AS (
  SELECT doc_id AS track_id,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, term) - 1 AS BIGINT) AS pos,
         term,
         cnt / sum(cnt) OVER (PARTITION BY doc_id) AS freq,
         cnt / max(cnt) OVER (PARTITION BY doc_id) AS weight
  FROM tcounts)"""

SONGS = """songs AS (
  SELECT CAST(p_partkey AS INTEGER) AS song_idx, 'SO' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS song_id,
         p_name AS title, p_brand AS artist_name, p_type AS release,
         'TR' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS track_id,
         p_retailprice AS duration, p_size AS key, CAST(1990 + p_size AS INTEGER) AS year
  FROM part),
played_ids AS (SELECT DISTINCT 'SO' || lpad(CAST(item_id AS VARCHAR), 10, '0') AS song_id FROM plays)"""

RAGGED = """flat AS (
  SELECT vec_id * 64 + (i - 1) AS pos, embedding[i] AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
offs AS (SELECT vec_id AS song_idx, vec_id * 64 AS idx FROM embeddings),
bounds AS (
  SELECT song_idx, idx AS start,
    coalesce(lead(idx) OVER (ORDER BY song_idx), (SELECT max(pos) + 1 FROM flat)) AS "end"
  FROM offs)"""

RAGGED_2D = """rows2 AS (
  SELECT vec_id * 8 + r AS pos, embedding[r * 8 + 1 : r * 8 + 8] AS value
  FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS r FROM embeddings)),
offs2 AS (SELECT vec_id AS song_idx, vec_id * 8 AS idx FROM embeddings),
bounds2 AS (
  SELECT song_idx, idx AS start,
    coalesce(lead(idx) OVER (ORDER BY song_idx), (SELECT max(pos) + 1 FROM rows2)) AS "end"
  FROM offs2)"""

MBTAGS = """mb AS (
  SELECT l.doc_id AS track_id, CAST(0 AS BIGINT) AS pos, d.source AS tag, l.toxic AS count
  FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1)"""


def _arrays_sql() -> str:
    """Every array field: its flat values, its own starts, and the range between two starts."""
    parts = []
    for k, (name, offset) in enumerate(RAGGED_FIELDS.items()):
        m = OFFSETS[offset]
        at = f"CAST({first_value(m)} AS BIGINT)"
        if name in TEXT_ARRAYS:
            cell = f"unnest([0]) AS j, CAST(NULL AS DOUBLE) AS num, concat('{name[:3]}', CAST((vec_id + i) % 13 AS VARCHAR)) AS txt"
        elif name in ROW_ARRAYS:
            cell = "unnest([0, 1, 2, 3]) AS j, CAST(embedding[i * 4 + 1 + unnest([0, 1, 2, 3])] AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt"
        else:
            cell = f"unnest([0]) AS j, CAST(embedding[i + {k + 1}] AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt"
        parts.append(f"""SELECT '{name}' AS field, b.song_idx, f.pos - b.start AS i, CAST(f.j AS INTEGER) AS j, round(f.num, 6) AS num, f.txt
FROM (SELECT vec_id AS song_idx, {at} AS start, lead({at}) OVER (ORDER BY vec_id) AS next FROM embeddings) b
JOIN (SELECT {at} + i AS pos, {cell} FROM (SELECT vec_id, embedding, unnest(range(0, vec_id * {m} % 7)) AS i FROM embeddings)) f
  ON f.pos >= b.start AND (b.next IS NULL OR f.pos < b.next)""")
    return "\nUNION ALL\n".join(parts)


def _group_agg_sql(agg: str) -> str:
    expr = {
        "avg": "avg(CASE WHEN x > 0 THEN x END)",
        "normalized_avg": "exp(avg(CASE WHEN x > 0 THEN ln(x) + 1 END))",
        "least_misery": "min(CASE WHEN x > 0 THEN x END)",
        "median": "median(CASE WHEN x > 0 THEN x END)",
        "weighted_avg": "avg(CASE WHEN x * wt > 0 THEN x * wt END)",
    }[agg]
    if agg == "weighted_avg":
        src = """(SELECT gp.group_id, gp.item_id, CAST(gp.play_count AS DOUBLE) AS x, 1.0 / us.mean AS wt
                  FROM group_plays gp JOIN user_stats us ON gp.user_id = us.id WHERE gp.split = 'train')"""
    else:
        src = "(SELECT group_id, item_id, CAST(play_count AS DOUBLE) AS x FROM group_plays WHERE split = 'train')"
    return (_w(PLAYS, USER_STATS, SPLIT, MEMBERSHIP, GROUP_PLAYS) +
            f"SELECT group_id, item_id, round(coalesce({expr}, 0.0), 6) AS score FROM {src} GROUP BY group_id, item_id")


def _liking_sql(full_join: bool) -> str:
    if full_join:
        return _w(PLAYS) + """, likes AS (SELECT item_id, count(*) AS liked FROM plays WHERE play_count > 10 GROUP BY item_id),
dis AS (SELECT item_id, count(*) AS not_liked FROM plays WHERE play_count <= 3 GROUP BY item_id),
j AS (SELECT coalesce(l.item_id, d.item_id) AS item_id, coalesce(l.liked, 0) AS liked,
             coalesce(d.not_liked, 0) AS not_liked
      FROM likes l FULL OUTER JOIN dis d ON l.item_id = d.item_id)
SELECT item_id, liked, not_liked, liked + not_liked AS total,
       round(liked / (liked + not_liked), 6) AS liking_percent FROM j"""
    return _w(PLAYS) + """, j AS (SELECT item_id, count(*) FILTER (WHERE play_count > 10) AS liked,
                 count(*) FILTER (WHERE play_count <= 3) AS not_liked FROM plays GROUP BY item_id),
nu AS (SELECT count(DISTINCT user_id) AS u FROM plays)
SELECT item_id, liked, not_liked, liked + not_liked AS total,
       round(liked / (liked + not_liked), 6) AS liking_percent,
       round((liked + not_liked) / (SELECT u FROM nu), 6) AS listen_percent
FROM j WHERE liked + not_liked > 0"""


def _pairs_sql() -> str:
    return """pairs AS (
  SELECT a.user_id AS user_u, min(b.user_id) AS user_v
  FROM membership a JOIN membership b ON a.group_id = b.group_id AND b.user_id > a.user_id
  GROUP BY a.group_id, a.user_id),
norms AS (SELECT user_id, sum(score) AS s, sqrt(sum(score * score)) AS nrm FROM centred_u GROUP BY user_id)"""


def _curve_sql(subsets: bool, points: tuple[int, ...]) -> str:
    tagged = ("SELECT p.*, c.c_mktsegment AS subset FROM plays p JOIN customer c ON c.c_custkey = p.user_id"
              if subsets else "SELECT p.*, 'all' AS subset FROM plays p")
    pts = ", ".join(f"({p})" for p in points)
    sel = "subset, " if subsets else ""
    return _w(PLAYS) + f""", tp AS ({tagged}),
occ AS (SELECT subset, item_id, count(*) AS o FROM tp GROUP BY subset, item_id),
top AS (SELECT * FROM (SELECT subset, item_id,
          row_number() OVER (PARTITION BY subset ORDER BY o DESC, item_id) AS rank FROM occ)
        WHERE rank <= {max(points)}),
on_top AS (SELECT tp.subset, tp.user_id, top.rank FROM tp JOIN top USING (subset, item_id)),
rpr AS (SELECT subset, rank, count(*) AS rr FROM on_top GROUP BY subset, rank),
best AS (SELECT subset, user_id, min(rank) AS rank FROM on_top GROUP BY subset, user_id),
upr AS (SELECT subset, rank, count(*) AS uu FROM best GROUP BY subset, rank),
tot AS (SELECT subset, count(*) AS all_rows, count(DISTINCT user_id) AS all_users FROM tp GROUP BY subset),
cur AS (
  SELECT t.subset, t.rank,
         sum(coalesce(rpr.rr, 0)) OVER (PARTITION BY t.subset ORDER BY t.rank
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
         sum(coalesce(upr.uu, 0)) OVER (PARTITION BY t.subset ORDER BY t.rank
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cu
  FROM top t LEFT JOIN rpr USING (subset, rank) LEFT JOIN upr USING (subset, rank))
SELECT {sel}CAST(cur.rank AS INTEGER) AS n, round(cr / all_rows * 100.0, 6) AS triplet_pct,
       round(cu / all_users * 100.0, 6) AS user_pct
FROM cur JOIN tot USING (subset) WHERE cur.rank IN (SELECT * FROM (VALUES {pts}) v(p))"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    stats_i = _w(PLAYS, ITEM_STATS)
    stats_u = _w(PLAYS, USER_STATS)

    # scans and sinks (the Spark side writes text and reads it back)
    q["scan_triplets_text"] = _w(PLAYS) + ("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) "
                                           "AS item_id, play_count FROM plays")
    q["scan_triplets_csv"] = q["scan_triplets_text"]
    q["scan_triplets_whitespace"] = q["scan_triplets_text"]
    q["scan_stats_text"] = stats_i + ("SELECT CAST(id AS VARCHAR) AS id, total_play, occurrence, round(mean, 6) "
                                      "AS mean FROM item_stats")
    q["write_stats"] = stats_u + ("SELECT CAST(id AS VARCHAR) AS id, total_play, occurrence, round(mean, 6) "
                                  "AS mean FROM user_stats")
    q["load_dataset"] = _w(PLAYS, USER_STATS, ITEM_STATS) + """SELECT CAST(p.item_id AS VARCHAR) AS item_id,
       CAST(p.user_id AS VARCHAR) AS user_id, p.play_count, round(u.mean, 6) AS user_mean, round(s.mean, 6) AS song_mean
FROM plays p JOIN user_stats u ON p.user_id = u.id JOIN item_stats s ON p.item_id = s.id"""
    q["dataset_views"] = _w(PLAYS, USER_STATS, ITEM_STATS) + """SELECT CAST(p.user_id AS VARCHAR) AS user_id,
       max(round(u.mean, 6)) AS user_mean, count(*) AS n_above, CAST(sum(p.play_count) AS BIGINT) AS plays_above
FROM plays p JOIN user_stats u ON p.user_id = u.id JOIN item_stats s ON p.item_id = s.id
WHERE p.play_count > round(s.mean, 6) GROUP BY p.user_id"""
    q["load_subset"] = _w(PLAYS) + """SELECT c.c_mktsegment AS subset, CAST(p.user_id AS VARCHAR) AS user_id,
       CAST(p.item_id AS VARCHAR) AS item_id, p.play_count
FROM plays p JOIN customer c ON c.c_custkey = p.user_id"""
    q["load_train_test"] = _w(PLAYS, SPLIT) + """SELECT CAST(user_id AS VARCHAR) AS user_id,
       CAST(item_id AS VARCHAR) AS item_id, play_count, split FROM split"""
    q["scan_id_list"] = "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part"
    q["scan_counts"] = _w(PLAYS) + "SELECT play_count FROM plays"
    q["save_groups"] = _w(PLAYS, SPLIT, MEMBERSHIP, GROUP_PLAYS) + "SELECT * FROM group_plays"
    q["load_groups"] = q["save_groups"]
    q["form_groups"] = q["save_groups"]
    q["write_triplets"] = _w(PLAYS, ITEM_STATS, SUBSET) + ("SELECT CAST(user_id AS VARCHAR) AS user_id, "
                                                           "CAST(item_id AS VARCHAR) AS item_id, play_count FROM sub")

    # subset and filters
    q["extract_subset"] = _w(PLAYS, ITEM_STATS, SUBSET) + "SELECT user_id, item_id, play_count FROM sub"
    q["join_active_users"] = q["extract_subset"]
    q["subset_summary"] = _w(PLAYS, ITEM_STATS, SUBSET) + """SELECT count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS users,
       count(DISTINCT item_id) + max(CASE WHEN item_id IS NULL THEN 1 ELSE 0 END) AS songs,
       count(*) AS triplets FROM sub"""
    q["filter_min_plays"] = _w(PLAYS) + "SELECT * FROM plays WHERE play_count > 1"
    q["popular_items"] = _w(PLAYS, ITEM_STATS, SUBSET) + "SELECT id FROM popular"
    q["join_popular_items"] = _w(PLAYS, ITEM_STATS, SUBSET) + "SELECT user_id, item_id, play_count FROM kept"
    q["active_users"] = _w(PLAYS, ITEM_STATS, SUBSET) + "SELECT id FROM active"

    # statistics
    q["song_play_mean"] = stats_i + "SELECT id, total_play, occurrence, round(mean, 6) AS mean FROM item_stats"
    q["occurrence_vs_total"] = stats_i + "SELECT id, occurrence, total_play FROM item_stats"
    q["user_play_mean"] = stats_u + "SELECT id, total_play, occurrence, round(mean, 6) AS mean FROM user_stats"
    fu = ("SELECT user_id AS id, CAST(sum(play_count) AS BIGINT) AS total_play FROM plays WHERE play_count > 1 "
          "GROUP BY user_id HAVING sum(play_count) > 1000")
    fs = ("SELECT item_id AS id, CAST(sum(play_count) AS BIGINT) AS total_play FROM plays WHERE play_count > 1 "
          "GROUP BY item_id HAVING sum(play_count) > 800")
    q["frequent_users"] = _w(PLAYS) + fu
    q["frequent_songs"] = _w(PLAYS) + fs
    q["top_users"] = _w(PLAYS) + f"SELECT total_play, id FROM ({fu}) ORDER BY total_play DESC, id LIMIT 10"
    q["top_songs"] = _w(PLAYS) + f"SELECT total_play, id FROM ({fs}) ORDER BY total_play DESC, id LIMIT 10"
    q["frequent_summary"] = _w(PLAYS) + f"SELECT (SELECT count(*) FROM ({fu})) AS frequent_users, " \
                                        f"(SELECT count(*) FROM ({fs})) AS frequent_songs"
    q["num_distinct"] = _w(PLAYS) + """SELECT count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS distinct_users,
       count(DISTINCT item_id) + max(CASE WHEN item_id IS NULL THEN 1 ELSE 0 END) AS distinct_items FROM plays"""
    q["overall_play_mean"] = _w(PLAYS) + ("SELECT CAST(sum(play_count) AS BIGINT) AS total_play, count(*) AS rows, "
                                          "round(avg(CAST(play_count AS DOUBLE)), 6) AS mean_play FROM plays")
    q["distinct_users"] = _w(PLAYS) + "SELECT DISTINCT user_id AS id FROM plays"
    q["distinct_songs"] = _w(PLAYS) + "SELECT DISTINCT item_id AS id FROM plays"
    q["play_histogram"] = _hist_sql()
    q["play_histogram_pct"] = f"SELECT bin, pct FROM ({_hist_sql()})"
    q["listen_counts_for_ids"] = _w(PLAYS) + """SELECT p.p_partkey AS id, CAST(coalesce(t.s, 0) AS BIGINT) AS listen_count
FROM part p LEFT JOIN (SELECT item_id, sum(play_count) AS s FROM plays GROUP BY item_id) t ON t.item_id = p.p_partkey"""

    # preference
    q["center_by_user"] = _w(PLAYS, USER_STATS, CENTER_USER) + \
        "SELECT user_id, item_id, round(score, 6) AS score FROM centred_u"
    q["center_by_item"] = _w(PLAYS, ITEM_STATS, CENTER_ITEM) + \
        "SELECT user_id, item_id, round(score, 6) AS score FROM centred_i"
    q["preference_class"] = _w(PLAYS, USER_STATS, CENTER_USER) + """SELECT user_id, item_id, round(score, 6) AS score,
       CASE WHEN score > 0.5 THEN 'liked' WHEN score < -0.5 THEN 'disliked'
            WHEN score < 0.5 AND score > -0.5 THEN 'neutral' END AS preference FROM centred_u"""
    for by, ctes, name in (("user", (PLAYS, USER_STATS, CENTER_USER), "centred_u"),
                           ("item", (PLAYS, ITEM_STATS, CENTER_ITEM), "centred_i")):
        base = _w(*ctes) + f"SELECT user_id, item_id, round(score, 6) AS score FROM {name} "
        q[f"liked_by_{by}_mean"] = base + "WHERE score > 0.5"
        q[f"disliked_by_{by}_mean"] = base + "WHERE score < -0.5"
        q[f"neutral_by_{by}_mean"] = base + "WHERE score < 0.5 AND score > -0.5"
    q["item_liking"] = _liking_sql(False)
    q["liking_outer_join"] = _liking_sql(True)
    pbase = _w(PLAYS, USER_STATS, CENTER_USER, MEMBERSHIP, _pairs_sql())
    q["user_similarity"] = pbase + """, dots AS (
  SELECT p.user_u, p.user_v, sum(a.score * b.score) AS dot
  FROM pairs p JOIN centred_u a ON a.user_id = p.user_u JOIN centred_u b ON b.user_id = p.user_v AND b.item_id = a.item_id
  GROUP BY p.user_u, p.user_v)
SELECT p.user_u, p.user_v, round(coalesce(d.dot, 0.0) / nullif(nu.nrm * nv.nrm, 0), 6) AS similarity
FROM pairs p JOIN norms nu ON nu.user_id = p.user_u JOIN norms nv ON nv.user_id = p.user_v
LEFT JOIN dots d ON d.user_u = p.user_u AND d.user_v = p.user_v"""
    q["user_similarity_crosssum"] = pbase + """SELECT p.user_u, p.user_v, round(nu.s * nv.s / nullif(nu.nrm * nv.nrm, 0), 6) + 0.0 AS similarity
FROM pairs p JOIN norms nu ON nu.user_id = p.user_u JOIN norms nv ON nv.user_id = p.user_v"""

    # indexing
    q["id_index_users"] = _w(INDEX_USERS) + "SELECT id, idx FROM uidx"
    q["id_index_items"] = _w(INDEX_ITEMS) + "SELECT id, idx FROM iidx"
    q["replace_ids"] = _w(PLAYS, INDEX_USERS, INDEX_ITEMS) + """SELECT u.idx AS user_id, i.idx AS item_id, p.play_count
FROM plays p JOIN uidx u ON u.id = p.user_id JOIN iidx i ON i.id = p.item_id"""
    q["replace_ids_keep"] = _w(PLAYS, INDEX_ITEMS) + """, u AS (SELECT c_custkey AS id,
  CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment < 'C' AND c_custkey IS NOT NULL))
SELECT u.idx AS user_id, i.idx AS item_id, p.play_count FROM plays p LEFT JOIN u ON u.id = p.user_id LEFT JOIN iidx i ON i.id = p.item_id"""
    q["user_item_matrix"] = _w(INDEX_USERS, INDEX_ITEMS) + """, lines AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS play_count,
         (l_orderkey * 8 + l_linenumber) * 1000 + CAST(l_quantity AS INTEGER) AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
last AS (SELECT user_id, item_id, arg_max(play_count, line_no) AS play_count FROM lines GROUP BY user_id, item_id)
SELECT u.idx AS row_idx, i.idx AS col_idx, l.play_count AS value
FROM last l JOIN uidx u ON u.id = l.user_id JOIN iidx i ON i.id = l.item_id"""

    # splitting
    q["split_train"] = _w(PLAYS, SPLIT) + "SELECT user_id, item_id, play_count FROM split WHERE split = 'train'"
    q["split_test"] = _w(PLAYS, SPLIT) + "SELECT user_id, item_id, play_count FROM split WHERE split = 'test'"
    q["cv_folds"] = _w(PLAYS, FOLDS) + "SELECT * FROM folded"
    q["cv_fold_train"] = _w(PLAYS, FOLDS) + "SELECT * FROM folded WHERE fold <> 0"
    q["cv_fold_test"] = _w(PLAYS, FOLDS) + "SELECT * FROM folded WHERE fold = 0"

    # groups
    q["group_users"] = _w(PLAYS, MEMBERSHIP) + "SELECT group_id, user_id FROM membership"
    q["group_weights"] = _w(PLAYS, USER_STATS, MEMBERSHIP) + """SELECT m.group_id, m.user_id, round(1.0 / s.mean, 6) AS weight
FROM membership m JOIN user_stats s ON s.id = m.user_id"""
    for agg in ("avg", "normalized_avg", "least_misery", "median", "weighted_avg"):
        q[f"group_agg_{agg}"] = _group_agg_sql(agg)
    q["virtual_users"] = "WITH " + GROUPS_BASE + "\nSELECT group_id, item_id, round(score, 6) AS score FROM vtrain"
    q["virtual_train_test"] = "WITH " + GROUPS_BASE + """
SELECT group_id, item_id, round(score, 6) AS score, 'train' AS split FROM vtrain
UNION ALL SELECT group_id, item_id, round(score, 6) AS score, 'test' AS split FROM vtest"""
    wide_cols = ", ".join(f"round(coalesce(max(CASE WHEN t.rank = {i} THEN v.score END), 0.0), 6) AS top{i}"
                          for i in range(1, 21))
    q["virtual_users_wide"] = "WITH " + GROUPS_BASE + f""", top AS ({_top_items('occurrence', 20)})
SELECT v.group_id, {wide_cols}
FROM vtrain v LEFT JOIN top t ON v.item_id = t.item_id GROUP BY v.group_id"""
    q["rating_tuples"] = "WITH " + GROUPS_BASE + \
        "\nSELECT group_id AS row, item_id, round(score, 6) AS rating FROM vtrain WHERE score <> 0"

    # similarity and kNN
    q["log_weight"] = _w(PLAYS) + \
        "SELECT user_id AS row, item_id, round(ln(play_count) + 1, 6) AS w FROM plays WHERE play_count > 0"
    q["log1p_weight"] = "WITH " + GROUPS_BASE + """
SELECT group_id AS row, item_id, round(ln(score + 1), 6) AS w FROM vtrain WHERE ln(score + 1) <> 0"""
    pw = "pw AS (SELECT user_id AS row, item_id, ln(play_count) + 1 AS w FROM plays WHERE play_count > 0)"
    q["item_cosine"] = _w(PLAYS, pw, _cosine_topk("pw", 50, "c")) + \
        "SELECT item_i, item_j, round(sim, 6) AS sim FROM c_cos"
    q["similar_items"] = _w(PLAYS, pw, _cosine_topk("pw", 30, "c")) + \
        "SELECT item_i, item_j, round(sim, 6) AS sim, rank FROM c_nb"
    q["item_cosine_groups"] = "WITH " + KNN + "\nSELECT item_i, item_j, round(sim, 6) AS sim FROM k_cos"
    q["k_similar_items"] = "WITH " + KNN + "\nSELECT item_i, item_j, round(sim, 6) AS sim, rank FROM k_nb"
    q["predict_knn"] = "WITH " + KNN + "\nSELECT row, item_id, round(score, 6) AS score FROM k_pred"
    q["recommend_knn"] = "WITH " + KNN + \
        "\nSELECT row, rank, item_id, round(score, 6) AS score FROM k_ranked WHERE rank <= 20"

    # popularity / random
    for by, col in (("total", "total_play"), ("occurrence", "occurrence"), ("mean", "mean")):
        q[f"top_songs_by_{by}"] = stats_i + _top_items(col, 20)
    users = "users AS (SELECT DISTINCT user_id AS entity FROM plays)"
    for by, col in (("occ", "occurrence"), ("tot", "total_play"), ("mean", "mean")):
        q[f"recommend_popular_{by}"] = _w(PLAYS, ITEM_STATS, users) + _popular_recs(20, "users", col)
    q["recommend_random"] = _w(PLAYS, ITEM_STATS, users) + _random_recs(20, "users")

    # lists and metrics
    q["recs_by_user"] = "WITH " + GROUPS_BASE + f""", r AS ({_popular_recs(20)})
SELECT entity, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS items FROM r GROUP BY entity"""
    q["labels_by_user"] = "WITH " + GROUPS_BASE + """
SELECT entity, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
FROM labels GROUP BY entity"""
    q["prediction_labels"] = "WITH " + KNN + f""", r AS ({_knn_recs(20)}),
rl AS (SELECT entity, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recs FROM r GROUP BY entity),
ll AS (SELECT entity, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS labels FROM labels GROUP BY entity)
SELECT rl.entity, rl.recs, coalesce(ll.labels, '') AS labels FROM rl LEFT JOIN ll USING (entity)"""
    q["hit_counts"] = "WITH " + KNN + ",\n" + _per_entity(_knn_recs(20)) + \
        "\nSELECT entity, n_recs, n_labels, hits FROM m_ent"
    q["rank_percentile"] = "WITH " + KNN + f""", r AS ({_knn_recs(20)}),
sz AS (SELECT entity, count(*) AS n FROM r GROUP BY entity)
SELECT l.entity, l.item_id, round(CASE WHEN r.rank IS NULL THEN 100.0 ELSE (r.rank - 1.0) / sz.n * 100.0 END, 6) AS pr
FROM labels l JOIN sz USING (entity) LEFT JOIN r ON r.entity = l.entity AND r.item_id = l.item_id"""
    pop = _metrics(GROUPS_BASE, _popular_recs(20))
    for m in ("map", "ndcg", "f1", "precision", "recall", "mpr"):
        key = "metric_ndcg10" if m == "ndcg" else f"metric_{m}"
        q[key] = f"SELECT {m} FROM ({pop})"
    q["evaluate_rankings"] = _metrics(KNN, _knn_recs(20))
    q["evaluate_knn"] = _sweep(KNN, _knn_recs(200))
    padded = """padded AS (
  SELECT row, rank, item_id, score FROM k_ranked WHERE rank <= 200 UNION ALL
  SELECT f.row, h.n + f.j, f.item_id, 0.0 FROM (
    SELECT e.row, i.item_id, row_number() OVER (PARTITION BY e.row ORDER BY i.item_id) AS j
    FROM (SELECT DISTINCT group_id AS row FROM vtrain WHERE score <> 0) e, (SELECT DISTINCT item_id FROM plays) i
    WHERE NOT EXISTS (SELECT 1 FROM vtrain v WHERE v.group_id = e.row AND v.item_id = i.item_id AND v.score <> 0)
      AND NOT EXISTS (SELECT 1 FROM k_ranked k WHERE k.row = e.row AND k.item_id = i.item_id AND k.rank <= 200)) f
  JOIN (SELECT e.row, count(k.row) AS n FROM (SELECT DISTINCT group_id AS row FROM vtrain WHERE score <> 0) e
        LEFT JOIN k_ranked k ON k.row = e.row AND k.rank <= 200 GROUP BY e.row) h ON h.row = f.row
  WHERE h.n + f.j <= 200)"""
    q["recommend_knn_padded"] = "WITH " + KNN + ",\n" + padded + \
        "\nSELECT row, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM padded"
    q["evaluate_knn_padded"] = _sweep(KNN + ",\n" + padded, "SELECT row AS entity, rank, item_id FROM padded")
    q["evaluate_popular"] = _sweep(GROUPS_BASE, _popular_recs(200))
    q["evaluate_random"] = _sweep(GROUPS_BASE, _random_recs(200))

    # cross-validation of the popularity recommenders
    cv = "WITH " + ",\n".join([PLAYS, FOLDS, """sets AS (SELECT f.k AS fold, g.i AS param_id FROM range(0, 5) f(k), range(0, 3) g(i)),
train AS (SELECT CAST(k AS INTEGER) AS test, t.* FROM range(0, 5) f(k), folded t WHERE t.fold <> f.k),
tstats AS (SELECT test, item_id, sum(play_count) AS tot, count(*) AS occ, CAST(sum(play_count) AS DOUBLE) / count(*) AS mean
           FROM train GROUP BY test, item_id),
best AS (SELECT test AS fold, s.i AS param_id, item_id, row_number() OVER (PARTITION BY test, s.i ORDER BY
           CASE s.i WHEN 0 THEN occ WHEN 1 THEN tot ELSE mean END DESC, item_id) AS rank
         FROM tstats, range(0, 3) s(i)),
cvlab AS (SELECT fold, user_id AS entity, item_id FROM folded)""",
        _per_entity("""SELECT b.fold, b.param_id, e.entity, b.rank, b.item_id FROM best b
  JOIN (SELECT DISTINCT test, user_id AS entity FROM train) e ON e.test = b.fold WHERE b.rank <= 200""",
                    "cvlab", "fold, param_id, entity", ent=("fold", "entity")),
        """cvs AS (SELECT CAST(fold AS INTEGER) AS fold, CAST(param_id AS INTEGER) AS param_id, avg(ap) AS map, avg(pr) AS mpr
  FROM m_ent GROUP BY ALL)""",
        """cvsum AS (SELECT param_id, avg(map) AS map_mean, min(map) AS map_min, max(map) AS map_max,
  avg(mpr) AS mpr_mean, min(mpr) AS mpr_min, max(mpr) AS mpr_max FROM cvs GROUP BY param_id)"""]) + "\n"
    six = "param_id, " + _round(["map_mean", "map_min", "map_max", "mpr_mean", "mpr_min", "mpr_max"])
    q["cross_validate_popular"] = cv + "SELECT fold, param_id, round(map, 6) AS map, round(mpr, 6) AS mpr FROM cvs"
    q["cv_summary_popular"] = cv + f"SELECT {six} FROM cvsum"
    q["cv_best_params_popular"] = cv + f"SELECT {six} FROM cvsum ORDER BY mpr_mean, param_id LIMIT 1"

    # coverage
    q["popularity_curve"] = _curve_sql(False, tuple(range(5, 201, 5)))
    q["popularity_curve_subsets"] = _curve_sql(True, tuple(range(5, 201, 5)))
    q["popularity_statistics"] = _curve_sql(False, (50,))
    q["log_occurrence_histogram"] = stats_i + """, lx AS (SELECT ln(CAST(occurrence AS DOUBLE)) AS x FROM item_stats),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM lx),
w AS (SELECT mn, CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END AS wd FROM mm),
b AS (SELECT CAST(least(floor((x - w.mn) * (20 / w.wd)), 19) AS INTEGER) AS bin FROM lx, w),
e AS (SELECT CAST(i AS INTEGER) AS bin, w.mn + i * w.wd / 20 AS lo, w.mn + (i + 1) * w.wd / 20 AS hi
      FROM range(0, 20) t(i), w)
SELECT e.bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM e LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c USING (bin)"""

    # catalogue
    q["catalogue_join"] = _w(PLAYS, SONGS) + """SELECT song_idx, song_id, title, artist_name, release, track_id,
       round(duration, 6) AS duration, key, year FROM songs"""
    q["catalogue_count"] = _w(PLAYS, SONGS) + "SELECT count(*) AS num_songs FROM songs"
    q["catalogue_fields"] = _w(PLAYS, SONGS) + "SELECT song_idx, title, round(duration, 6) AS duration, year FROM songs"
    q["track_record_terms"] = _w(DOC_TERMS) + \
        "SELECT track_id, pos, term, round(freq, 6) AS freq, round(weight, 6) AS weight FROM terms"
    q["label_blocks"] = "WITH " + GROUPS_BASE + """,
vidx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM plays))
SELECT entity, idx // 128 AS block, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
FROM (SELECT DISTINCT entity, item_id FROM labels) JOIN vidx USING (item_id) GROUP BY entity, idx // 128"""
    q["train_als"] = "WITH " + GROUPS_BASE + """
SELECT DISTINCT CAST(group_id AS INTEGER) AS row, CAST(10 AS INTEGER) AS rank FROM vtrain WHERE score <> 0"""
    q["top_n_factors"] = """WITH s AS (
  SELECT u.vec_id AS row, v.vec_id AS item_id, list_sum(list_transform(range(1, len(u.embedding) + 1),
    lambda i: CAST(u.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))) AS score FROM embeddings u, embeddings v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY round_even(score, 9) DESC, item_id) AS INTEGER) AS rank FROM s)
SELECT row, rank, item_id, round(score, 6) AS score FROM r WHERE rank <= 20"""
    q["catalogue_scalars"] = "SELECT CAST(p_partkey AS INTEGER) AS song_idx, " + ", ".join(
        f"round({e}, 6) AS {n}" if "DOUBLE" in e or "retailprice" in e else f"{e} AS {n}" for n, e in SCALARS.items()) + " FROM part"
    q["catalogue_arrays"] = _arrays_sql()
    q["ragged_slice_arrays"] = _w(RAGGED) + """SELECT b.song_idx, CAST(count(*) AS INTEGER) AS n,
  string_agg(CAST(CAST(round(CAST(f.value AS DOUBLE) * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY f.pos) AS thousandths
FROM bounds b JOIN flat f ON f.pos >= b.start AND f.pos < b."end" GROUP BY b.song_idx"""
    q["virtual_user_blocks"] = "WITH " + GROUPS_BASE + """,
vidx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM plays)),
vcell AS (SELECT v.group_id, idx // 1024 AS block, idx % 1024 AS p, round(v.score, 6) AS s FROM vtrain v JOIN vidx USING (item_id)),
vkey AS (SELECT DISTINCT group_id, block FROM vcell)
SELECT k.group_id, CAST(k.block AS INTEGER) AS block, list(coalesce(c.s, 0.0::DOUBLE) ORDER BY r.p) AS scores
FROM (SELECT group_id, block, unnest(range(0, 1024)) AS p FROM vkey) r JOIN vkey k USING (group_id, block)
LEFT JOIN vcell c ON c.group_id = r.group_id AND c.block = r.block AND c.p = r.p GROUP BY k.group_id, k.block"""
    q["ragged_slice"] = _w(RAGGED) + """SELECT b.song_idx, f.pos - b.start AS i, f.value
FROM bounds b JOIN flat f ON f.pos >= b.start AND f.pos < b."end\""""
    q["ragged_slice_2d"] = _w(RAGGED_2D) + """, sl AS (SELECT b.song_idx, r.pos - b.start AS i, r.value
  FROM bounds2 b JOIN rows2 r ON r.pos >= b.start AND r.pos < b."end")
SELECT song_idx, i, CAST(j - 1 AS INTEGER) AS j, value[j] AS value
FROM (SELECT song_idx, i, value, unnest(range(1, len(value) + 1)) AS j FROM sl)"""
    q["song_idx_lookup"] = _w(PLAYS, SONGS) + """SELECT s.song_id, max(s.song_idx) AS song_idx FROM songs s
WHERE s.song_id IN (SELECT song_id FROM played_ids) GROUP BY s.song_id"""
    q["song_index_of"] = _w(PLAYS, SONGS) + """SELECT i.song_id, min(s.song_idx) AS song_idx
FROM played_ids i LEFT JOIN songs s USING (song_id) GROUP BY i.song_id"""
    q["song_details"] = _w(PLAYS, SONGS) + """SELECT s.song_id, s.artist_name, s.release, s.title, s.track_id
FROM songs s JOIN played_ids USING (song_id)"""
    q["artist_terms"] = _w(DOC_TERMS) + \
        "SELECT track_id, pos, term, round(freq, 6) AS freq, round(weight, 6) AS weight FROM terms"
    q["similar_artists"] = "SELECT conv_id AS track_id, turn AS pos, role AS artist FROM conversations"
    q["artist_mbtags"] = _w(MBTAGS) + "SELECT track_id, pos, tag, count FROM mb"
    q["track_records"] = _w(DOC_TERMS) + """, tt AS (SELECT track_id, count(*) AS n FROM terms GROUP BY track_id),
sa AS (SELECT conv_id AS track_id, string_agg(role, ',' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
SELECT coalesce(tt.track_id, sa.track_id) AS track_id, CAST(coalesce(tt.n, 0) AS INTEGER) AS n_terms,
       coalesce(sa.s, '') AS similar_artists
FROM tt FULL OUTER JOIN sa ON tt.track_id = sa.track_id"""

    # streaming (the finished stream equals the batch statistics)
    q["stream_song_play_mean"] = stats_i + ("SELECT CAST(id AS VARCHAR) AS id, total_play, occurrence, "
                                            "round(mean, 6) AS mean FROM item_stats")
    return q


ORACLE_SQL = build()
