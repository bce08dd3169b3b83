"""Queries over the fixtures and their DuckDB twins. A query and its SQL stand side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import schema, stages
from siltstone.functions import text, vectors
from siltstone.operators import audits, index, judging, labels, lists, listwise, losses, metrics, mining, mixture, shards, topk
from siltstone.plans import fixtures as fx
from siltstone.plans.fixtures import Fixtures
from siltstone.sources import npz, readers, restart, sinks

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        name = f.__name__

        def run(spark, sf_dir) -> DataFrame:
            df = f(Fixtures(spark, sf_dir))
            return df.select([F.col(c.name).cast("bigint").alias(c.name) if isinstance(c.dataType, T.IntegerType) else F.col(c.name) for c in df.schema])

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = _with(sql)
        return f

    return add


def _maxsim(q: str, d: str, kind: tuple[int, int], each: str = "{}") -> str:
    n, w = kind
    best = f"list_max(list_transform(range(0, {n}), lambda j: list_dot_product({q}[i*{w}+1:i*{w}+{w}], {d}[j*{w}+1:j*{w}+{w}])))"
    return f"list_sum(list_transform(range(0, {n}), lambda i: {each.format(best)}))"


def _nearest(centroids: str) -> str:
    """Each document token with its nearest centroid, distances to nine places."""
    near = "round(list_dot_product(d.x, i.y) - list_dot_product(i.y, i.y) / 2, 9)"
    return f"SELECT document_id, j, x, c FROM (SELECT d.document_id, d.j, d.x, i.c, row_number() OVER (PARTITION BY d.document_id, d.j ORDER BY {near} DESC, i.c) AS n FROM dtok d, {centroids} i) WHERE n = 1"


def _means(centroids: str, tokens: str) -> str:
    mean = f"SELECT c, list(a ORDER BY k) AS y FROM (SELECT c, k, round(avg(x[k]), 9) AS a FROM {tokens}, range(1, {fx.MINER[1] + 1}) r(k) GROUP BY c, k) GROUP BY c"
    return f"SELECT i.c, coalesce(m.y, i.y) AS y FROM {centroids} i LEFT JOIN ({mean}) m ON m.c = i.c"


def _ranked(source: str, k: int, score: str = "score", extra: str = "") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY round({score}, 9) DESC, document_id{extra}) AS rank FROM {source}) WHERE rank <= {k}"


_FINITE = "isfinite(score) AND document_id >= 0"
#: Views that queries share, by name; `_with` puts those that a query names before it.
VIEWS = {
    "vec": "SELECT e.vec_id, 'c' || ((e.vec_id // 10) % 4)::VARCHAR AS split, d.text, e.embedding::DOUBLE[] AS v, e.label::BIGINT AS label, e.vec_id % 10 = 0 AS is_query FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id",
    "fq": "SELECT split, vec_id AS query_id, text AS query, v, label FROM vec WHERE is_query",
    "fd": "SELECT split, vec_id AS document_id, text AS document, v, label FROM vec WHERE NOT is_query",
    "positives": "SELECT q.split, q.query_id, d.document_id, row_number() OVER (PARTITION BY q.split, q.query_id ORDER BY d.document_id) AS label_pos FROM fq q JOIN fd d ON q.split = d.split AND q.label = d.label WHERE d.document_id % 10 IN (1, 2)",
    "miner": f"SELECT q.split, q.query_id, d.document_id, {_maxsim('q.v', 'd.v', fx.MINER)} AS score FROM fq q JOIN fd d ON q.split = d.split",
    "dtok": f"SELECT split, document_id, j, v[j*{fx.MINER[1]}+1:j*{fx.MINER[1]}+{fx.MINER[1]}] AS x FROM fd, range({fx.MINER[0]}) r(j)",
    "icent": f"SELECT row_number() OVER (ORDER BY document_id, j) - 1 AS c, x AS y FROM dtok QUALIFY c < {fx.CENTROIDS}",
    "inear": _nearest("icent"),
    "icentb": _means("icent", "inear"),
    "inearb": _nearest("icentb"),
    "icentc": _means("icentb", "inearb"),
    "inearc": _nearest("icentc"),
    "ireach": "SELECT max(list_max(list_transform(list_zip(a.x, i.y), lambda z: abs(z[1] - z[2])))) AS w FROM inearc a JOIN icentc i ON i.c = a.c",
    "icode": f"SELECT a.document_id, a.c, a.x, list_transform(list_zip(a.x, i.y), lambda z: z[2] + (-w + (least(floor((z[1] - z[2] + w) / (2 * w / {2**index.BITS})), {2**index.BITS - 1}) + 0.5::DOUBLE) * (2 * w / {2**index.BITS}))) AS y FROM inearc a JOIN icentc i ON i.c = a.c, ireach",
    "ifar": "SELECT document_id, max(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS far FROM icode GROUP BY document_id",
    "iprobe": f"SELECT *, max(near) FILTER (WHERE n = {fx.PROBES + 1}) OVER (PARTITION BY query_id, t) AS missed FROM (SELECT q.split, q.query_id, q.t, q.q, i.c, list_dot_product(q.q, i.y) AS near, row_number() OVER (PARTITION BY q.query_id, q.t ORDER BY round(list_dot_product(q.q, i.y), 9) DESC, i.c) AS n FROM (SELECT split, query_id, t, v[t*{fx.MINER[1]}+1:t*{fx.MINER[1]}+{fx.MINER[1]}] AS q FROM fq, range({fx.MINER[0]}) r(t)) q, icentc i)",
    "imet": f"SELECT p.split, p.query_id, p.t, k.document_id, greatest(coalesce(max(CASE WHEN p.n <= {fx.PROBES} THEN list_dot_product(p.q, k.y) END), any_value(p.missed)), any_value(p.missed)) AS best, any_value(sqrt(list_dot_product(p.q, p.q))) AS length FROM iprobe p JOIN icode k ON k.c = p.c JOIN fd d ON d.document_id = k.document_id AND d.split = p.split GROUP BY ALL",
    "iscore": f"SELECT m.split, m.query_id, m.document_id, round(sum(best) - {index.SLACK}::DOUBLE * sum(length) * any_value(far), 9) AS low, round(sum(best) + {index.SLACK}::DOUBLE * sum(length) * any_value(far), 9) AS high FROM imet m JOIN ifar f ON f.document_id = m.document_id GROUP BY ALL",
    "ileft": f"SELECT split, query_id, document_id FROM (SELECT *, max(low) FILTER (WHERE nth = {fx.INDEX_K}) OVER (PARTITION BY split, query_id) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY low DESC) AS nth FROM iscore)) WHERE edge IS NULL OR high >= edge",
    "iexact": "SELECT l.split, l.query_id, l.document_id, m.score, count(*) OVER (PARTITION BY l.split, l.query_id) AS scored FROM ileft l JOIN miner m ON m.split = l.split AND m.query_id = l.query_id AND m.document_id = l.document_id",
    "ifound": _ranked("iexact", fx.INDEX_K),
    "densepairs": "SELECT q.split, q.query_id, d.document_id, list_dot_product(q.v, d.v) AS score FROM fq q JOIN fd d ON q.split = d.split",
    "cand": _ranked("miner", fx.DEPTH),
    "dcand": _ranked("densepairs", fx.DEPTH),
    "free": "SELECT split, query_id, document_id, row_number() OVER (PARTITION BY split, query_id ORDER BY round(score, 9) DESC, document_id) AS r FROM cand c WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.split = c.split AND p.query_id = c.query_id AND p.document_id = c.document_id) AND EXISTS (SELECT 1 FROM positives p WHERE p.split = c.split AND p.query_id = c.query_id)",
    "mined": f"SELECT split, query_id, document_id, r - {fx.SKIP} AS neg_rank, count(*) OVER (PARTITION BY split, query_id) AS n FROM free WHERE r > {fx.SKIP} AND r <= {fx.SKIP + fx.TOP_K} QUALIFY n = {fx.TOP_K}",
    "minedpairs": "SELECT p.split, p.query_id, p.document_id AS positive_id FROM positives p WHERE (p.split, p.query_id) IN (SELECT split, query_id FROM mined)",
    "gold": f"SELECT * FROM positives WHERE label_pos <= {fx.GOLD_CAP}",
    "textdocs": "SELECT split, document_id FROM fd WHERE document IS NOT NULL AND document <> ''",
    "jgold": "SELECT split, query_id, document_id, label_pos AS rank FROM gold WHERE (split, document_id) IN (SELECT * FROM textdocs)",
    "jcut": "SELECT split, query_id, document_id, row_number() OVER (PARTITION BY split, query_id ORDER BY round(score, 9) DESC, document_id) AS rank FROM cand c WHERE NOT EXISTS (SELECT 1 FROM gold p WHERE p.split = c.split AND p.query_id = c.query_id AND p.document_id = c.document_id)",
    "jcand": f"SELECT * FROM jcut WHERE rank <= {fx.TOP_N} AND (split, document_id) IN (SELECT * FROM textdocs)",
    "elig": "SELECT split, query_id FROM fq WHERE query IS NOT NULL AND (split, query_id) IN (SELECT split, query_id FROM cand) AND (split, query_id) IN (SELECT split, query_id FROM positives)",
    "jboth": "SELECT *, count(*) FILTER (WHERE section = 'gold') OVER w AS g, count(*) FILTER (WHERE section = 'cand') OVER w AS c FROM (SELECT 'gold' AS section, * FROM jgold UNION ALL SELECT 'cand', * FROM jcand) WHERE (split, query_id) IN (SELECT * FROM elig) WINDOW w AS (PARTITION BY split, query_id)",
    "pool": f"SELECT j.split, j.query_id, section, j.document_id, rank, {_maxsim('q.v', 'd.v', fx.JUDGE)} AS judge_score FROM jboth j JOIN fq q ON j.split = q.split AND j.query_id = q.query_id JOIN fd d ON j.split = d.split AND j.document_id = d.document_id WHERE g >= 1 AND c >= {fx.LEAST}",
    "judged": "SELECT p.split, p.query_id, p.positive_id, g.judge_score AS positive_score, c.document_id, c.judge_score AS score FROM minedpairs p JOIN pool g ON g.section = 'gold' AND g.split = p.split AND g.query_id = p.query_id AND g.document_id = p.positive_id JOIN pool c ON c.section = 'cand' AND c.split = p.split AND c.query_id = p.query_id",
    "perpair": "SELECT split, query_id, positive_id, count(*) AS c, count(*) FILTER (WHERE score >= positive_score) AS v FROM judged GROUP BY ALL",
    "risks": "SELECT s.split, coalesce(n, 0)::BIGINT AS judged_pairs, coalesce(c, 0)::BIGINT AS candidates, coalesce(v, 0)::BIGINT AS vetoed, coalesce(v, 0)::DOUBLE / greatest(coalesce(c, 0), 1)::DOUBLE AS risk FROM (SELECT DISTINCT split FROM vec) s LEFT JOIN (SELECT split, count(*) AS n, sum(c) AS c, sum(v) AS v FROM perpair GROUP BY split) x ON s.split = x.split",
    "surv": f"SELECT *, score / greatest(positive_score, 1e-9::DOUBLE) AS ratio, count(*) OVER w AS survivors, count(*) FILTER (WHERE score / greatest(positive_score, 1e-9::DOUBLE) >= {fx.BAND}::DOUBLE) OVER w AS in_band FROM judged WHERE score < positive_score WINDOW w AS (PARTITION BY split, query_id, positive_id)",
    "band": f"SELECT split, query_id, positive_id, positive_score, document_id, ratio, survivors, row_number() OVER (PARTITION BY split, query_id, positive_id ORDER BY round(ratio, 9) DESC, document_id) AS pool_rank FROM surv WHERE survivors >= {fx.NEGATIVES} QUALIFY pool_rank <= greatest(in_band, {fx.NEGATIVES})",
    "usable": "SELECT split, query_id, positive_id, max(positive_score) AS positive_score, max(survivors) AS survivors, count(*) AS pool_size FROM band GROUP BY ALL",
    "weights": "SELECT r.split, r.risk, coalesce(n, 0)::BIGINT AS usable_pairs, sqrt(coalesce(n, 0)::DOUBLE) * (1.0::DOUBLE - r.risk) AS weight FROM risks r LEFT JOIN (SELECT split, count(*) AS n FROM usable GROUP BY split) u ON r.split = u.split",
    "shares": f"SELECT *, {fx.BUDGET} * weight / sum(round(weight, 12)) OVER () AS exact FROM weights",
    "goals": f"SELECT split, usable_pairs, risk, weight, exact, (floor(exact) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, split) <= {fx.BUDGET} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM shares",
    "drawn": f"SELECT u.split, u.query_id, u.positive_id, row_number() OVER (PARTITION BY u.split ORDER BY u.query_id, u.positive_id) - 1 AS at, row_number() OVER (PARTITION BY u.split ORDER BY md5('{fx.SEED}|' || u.split || '|' || u.query_id || '|' || u.positive_id), u.query_id, u.positive_id) AS nth, count(*) OVER (PARTITION BY u.split) AS n, g.target FROM usable u JOIN goals g ON g.split = u.split",
    "sampledrows": f"SELECT split, query_id, positive_id, 0::BIGINT AS copy_no FROM drawn WHERE nth <= target UNION ALL SELECT d.split, d.query_id, d.positive_id, x.copy_no FROM (SELECT split, n, unnest(range(1, target - n + 1)) AS copy_no FROM (SELECT DISTINCT split, n, target FROM drawn) WHERE target > n) x JOIN drawn d ON d.split = x.split AND d.at = ('0x' || substr(md5('{fx.SEED}|' || x.split || '|draw|' || x.copy_no), 1, 15))::BIGINT % x.n",
    "sft": f"SELECT s.split, s.query_id, s.positive_id, s.copy_no, b.document_id, row_number() OVER (PARTITION BY s.split, s.query_id, s.positive_id, s.copy_no ORDER BY md5('{fx.SEED}|' || s.split || '|' || s.query_id || '|' || s.positive_id || '|' || s.copy_no || '|' || b.document_id), b.document_id) AS slot FROM sampledrows s JOIN band b ON b.split = s.split AND b.query_id = s.query_id AND b.positive_id = s.positive_id QUALIFY slot <= {fx.NEGATIVES}",
    "ranks": "SELECT split, query_id, document_id, section, row_number() OVER (PARTITION BY split, query_id ORDER BY section DESC, CASE WHEN section = 'gold' THEN rank END, round(judge_score, 9) DESC, document_id) AS pos FROM pool",
    "kd": f"SELECT split, substr(split, 2)::BIGINT * 1000000000 + query_id AS query_id, substr(split, 2)::BIGINT * 1000000000 + document_id AS document_id, pos, section, query_id AS q, document_id AS d, count(*) OVER (PARTITION BY split, query_id) AS n FROM ranks WHERE pos <= {fx.WIDTH} QUALIFY n = {fx.WIDTH}",
    "kdscores": f"SELECT k.query_id, k.pos, k.document_id, {_maxsim('q.v', 'd.v', fx.TEACHER)} AS teacher, {_maxsim('q.v', 'd.v', fx.MINER)} AS student FROM kd k JOIN fq q ON q.split = k.split AND q.query_id = k.q JOIN fd d ON d.split = k.split AND d.document_id = k.d",
    "kdvec": "SELECT k.query_id, k.pos, k.document_id, q.v AS q, d.v AS d FROM kd k JOIN fq q ON q.split = k.split AND q.query_id = k.q JOIN fd d ON d.split = k.split AND d.document_id = k.d",
    "kdatt": "SELECT i.query_id, i.pos, i.document_id, (list_dot_product(i.q, i.d) + sum(exp(list_dot_product(i.d, j.d) / 8) * list_dot_product(j.q, j.d)) / sum(exp(list_dot_product(i.d, j.d) / 8))) / 2 AS score FROM kdvec i JOIN kdvec j ON j.query_id = i.query_id AND j.pos <= i.pos GROUP BY i.query_id, i.pos, i.document_id, i.q, i.d",
    "kdword": "SELECT DISTINCT k.query_id, k.pos, w.t FROM (SELECT k.query_id, k.pos, list_intersect(string_split(q.query, ' ')[:64], string_split(d.document, ' ')[:300]) AS ts FROM kd k JOIN fq q ON q.split = k.split AND q.query_id = k.q JOIN fd d ON d.split = k.split AND d.document_id = k.d) k, unnest(k.ts) w(t) WHERE w.t <> ''",
    "kdscaled": "SELECT *, (teacher - min(teacher) OVER w) / (max(teacher) OVER w - min(teacher) OVER w + 1e-8::DOUBLE) AS t, (student - min(student) OVER w) / (max(student) OVER w - min(student) OVER w + 1e-8::DOUBLE) AS s FROM kdscores WINDOW w AS (PARTITION BY query_id)",
    "kdlog": "SELECT *, t / 0.3::DOUBLE - ln(sum(exp(t / 0.3::DOUBLE)) OVER w) AS lt, s / 0.3::DOUBLE - ln(sum(exp(s / 0.3::DOUBLE)) OVER w) AS ls, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, pos) AS best FROM kdscaled WINDOW w AS (PARTITION BY query_id)",
    "kdloss": "SELECT query_id, sum(exp(lt) * (lt - ls)) AS kl, ln(sum(exp((s - 1) / 0.05::DOUBLE)) FILTER (WHERE best = 1 OR t <= 0.6::DOUBLE)) + 1 / 0.05::DOUBLE - max(s) FILTER (WHERE best = 1) / 0.05::DOUBLE AS nce FROM kdlog GROUP BY query_id",
    "mvcut": "SELECT *, count(*) OVER (PARTITION BY split, query_id) AS n FROM cand c WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM positives p WHERE p.split = c.split AND p.query_id = c.query_id AND p.document_id = c.document_id) QUALIFY n = 10",
    "dncut": "SELECT *, count(*) OVER (PARTITION BY split, query_id) AS n FROM dcand c WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM positives p WHERE p.split = c.split AND p.query_id = c.query_id AND p.document_id = c.document_id) QUALIFY n = 10",
    "arms": "SELECT a.*, p.document_id AS positive_id FROM (SELECT split, query_id, 'mv' AS source, rank AS neg_rank, document_id FROM mvcut UNION ALL SELECT split, query_id, 'dense', rank, document_id FROM dncut) a JOIN positives p ON p.split = a.split AND p.query_id = a.query_id WHERE (a.split, a.query_id) IN (SELECT split, query_id FROM mvcut) AND (a.split, a.query_id) IN (SELECT split, query_id FROM dncut) AND (a.split, a.query_id) IN (SELECT split, query_id FROM fq WHERE query IS NOT NULL)",
    "armscores": f"SELECT a.*, CASE WHEN d.document <> '' THEN {_maxsim('q.v', 'd.v', fx.TEACHER)} END AS score, CASE WHEN p.document <> '' THEN {_maxsim('q.v', 'p.v', fx.TEACHER)} END AS positive_score FROM arms a JOIN fq q ON q.split = a.split AND q.query_id = a.query_id JOIN fd d ON d.split = a.split AND d.document_id = a.document_id JOIN fd p ON p.split = a.split AND p.document_id = a.positive_id",
    "armrows": "SELECT split, query_id, positive_id, avg((score > positive_score)::INT::DOUBLE) FILTER (WHERE source = 'mv') AS mf, avg((score > positive_score)::INT::DOUBLE) FILTER (WHERE source = 'dense') AS df, avg(score) FILTER (WHERE source = 'mv') AS mh, avg(score) FILTER (WHERE source = 'dense') AS dh, (20 - count(DISTINCT document_id)) / 10.0::DOUBLE AS shared FROM armscores WHERE positive_score IS NOT NULL GROUP BY split, query_id, positive_id HAVING count(DISTINCT document_id) FILTER (WHERE score IS NOT NULL) >= 2 AND count(score) FILTER (WHERE source = 'mv') > 0 AND count(score) FILTER (WHERE source = 'dense') > 0",
    "audit": "SELECT split, count(*) AS n, round(avg(round(mf, 12)), 4) AS mv_false_negative_rate, round(avg(round(df, 12)), 4) AS dense_false_negative_rate, round(avg(round(mh, 12)), 4) AS mv_mean_negative_score, round(avg(round(dh, 12)), 4) AS dense_mean_negative_score, round(avg(round(shared, 12)), 4) AS set_overlap FROM armrows GROUP BY split",
    "turns": "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS query, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS positive FROM conversations GROUP BY conv_id",
    "convs": "SELECT conv_id, query, positive, row_number() OVER (ORDER BY conv_id) - 1 AS at, count(*) OVER () AS n FROM turns WHERE query IS NOT NULL AND positive IS NOT NULL",
    "triples": "SELECT c.conv_id AS row_id, c.query, c.positive, k AS neg_no, o.positive AS negative FROM convs c, range(1, 13) r(k), convs o WHERE o.at = (c.at + k) % c.n",
    "lexical": "SELECT row_id, neg_no, len(list_intersect(list_filter(list_distinct(string_split(lower(query), ' ')), lambda x: x <> ''), string_split(lower(positive), ' '))) AS pos_score, len(list_intersect(list_filter(list_distinct(string_split(lower(query), ' ')), lambda x: x <> ''), string_split(lower(negative), ' '))) AS neg_score FROM triples",
    "vetoed": f"SELECT *, neg_score < pos_score AS survives, count(*) FILTER (WHERE neg_score < pos_score) OVER (PARTITION BY row_id) AS survivors, count(*) FILTER (WHERE neg_score < pos_score) OVER (PARTITION BY row_id) >= {fx.NEGATIVES} AS kept FROM lexical",
    "ttarget": f"SELECT usable, negatives_in, negatives_vetoed, short, risk, round_even({float(mixture.CALIBRATION[2])}::DOUBLE * (sqrt(usable::DOUBLE) * (1.0::DOUBLE - risk) / {mixture.CALIBRATION[0]**0.5 * (1 - mixture.CALIBRATION[1])!r}::DOUBLE), 0)::BIGINT AS target FROM (SELECT *, negatives_vetoed::DOUBLE / greatest(negatives_in, 1)::DOUBLE AS risk FROM (SELECT count(DISTINCT row_id) FILTER (WHERE kept) AS usable, count(*) AS negatives_in, count(*) FILTER (WHERE NOT survives) AS negatives_vetoed, count(DISTINCT row_id) FILTER (WHERE NOT kept) AS short FROM vetoed))",
    "qrels": "SELECT q.split AS dataset, q.query_id::VARCHAR AS query_id, d.vec_id::VARCHAR AS doc_id, CASE WHEN d.split = q.split THEN 2 ELSE 1 END::BIGINT AS rel FROM fq q JOIN vec d ON d.label = q.label AND d.vec_id <> q.query_id",
    "allpairs": "SELECT q.split, q.query_id, d.vec_id AS document_id, list_dot_product(q.v, d.v) AS score FROM fq q, vec d",
    "top100": _ranked("allpairs", 100),
    "run": "SELECT split AS dataset, query_id::VARCHAR AS query_id, document_id::VARCHAR AS doc_id, score, row_number() OVER (PARTITION BY split, query_id ORDER BY rank) AS rank FROM top100 WHERE document_id <> query_id",
    "ideal": "SELECT dataset, query_id, count(*) AS n_rel, sum(rel / log2(i + 1)) FILTER (WHERE i <= 10) AS i10, sum(rel / log2(i + 1)) FILTER (WHERE i <= 100) AS i100 FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY rel DESC, doc_id) AS i FROM qrels) GROUP BY ALL",
    "hits": "SELECT r.dataset, r.query_id, r.rank, q.rel, row_number() OVER (PARTITION BY r.dataset, r.query_id ORDER BY r.rank) AS nth FROM run r JOIN qrels q ON q.dataset = r.dataset AND q.query_id = r.query_id AND q.doc_id = r.doc_id",
    "hitrows": "SELECT dataset, query_id, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 10) AS d10, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= 100) AS d100, count(*) FILTER (WHERE rank <= 10)::DOUBLE AS h10, count(*) FILTER (WHERE rank <= 100)::DOUBLE AS h100, sum(nth::DOUBLE / rank) AS ap, min(rank) AS first FROM hits GROUP BY ALL",
    "irm": "SELECT i.dataset, "
    + ", ".join(f"round(avg(round(coalesce({x}, 0), 12)), 6) AS {n}" for x, n in (("d10 / i10", "ndcg_10"), ("d100 / i100", "ndcg_100"), ("h10 / n_rel", "recall_10"), ("h100 / n_rel", "recall_100"), ("ap / n_rel", "map"), ("CASE WHEN first <= 10 THEN 1.0::DOUBLE / first END", "mrr_10"), ("h10 / 10.0::DOUBLE", "precision_10")))
    + " FROM ideal i LEFT JOIN hitrows h ON h.dataset = i.dataset AND h.query_id = i.query_id GROUP BY i.dataset",
}


def _with(sql: str) -> str:
    needed, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(VIEWS[name])
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in needed)
    own = sql.removeprefix("WITH ")
    return f"WITH {views}{', ' if own != sql else ' '}{own}" if views else sql


def _shard_queries() -> None:
    for name, cut in (("shard_contiguous", shards.contiguous), ("shard_strided", shards.strided), ("shard_proportional", shards.proportional)):
        at = {"shard_contiguous": "(nth // ceil(n / 7.0)::BIGINT)", "shard_strided": "nth % 7", "shard_proportional": "((nth + 1) * 7 - 1) // n"}[name]

        def run(f: Fixtures, cut=cut):
            return cut(f.documents.select("split", "document_id"), "document_id", 7).select("split", "document_id", "shard")

        run.__name__ = name
        query(f"SELECT split, document_id, ({at})::BIGINT AS shard FROM (SELECT split, document_id, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY split) AS n FROM fd WINDOW w AS (PARTITION BY split ORDER BY document_id))")(run)


_shard_queries()


# Scans and projections


@query("SELECT split, document_id, length(document) AS n_chars FROM fd WHERE split = 'c1'")
def scan_split(f):
    return f.documents.where("split = 'c1'").select("split", "document_id", F.length("document").alias("n_chars"))


@query("SELECT split, query_id, label_pos, document_id AS positive_id FROM positives")
def gold_first_element(f):
    rows = f.positives.select("split", "query_id", "label_pos", F.array("document_id", F.col("document_id") + 1).alias("document_ids"))
    empty = rows.withColumn("document_ids", F.array().cast("array<bigint>"))
    return labels.first_element(rows.union(empty)).select("split", "query_id", "label_pos", F.col("document_id").alias("positive_id"))


@query(f"SELECT split, query_id, document_id FROM (SELECT split, query_id, document_id, CASE WHEN document_id % 5 = 0 THEN 'nan'::DOUBLE WHEN document_id % 7 = 0 THEN '-inf'::DOUBLE ELSE score END AS score FROM cand) WHERE {_FINITE}")
def cand_valid(f):
    s = F.when(F.col("document_id") % 5 == 0, F.lit(float("nan"))).when(F.col("document_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("score"))
    padded = f.queries.select("split", "query_id", F.lit(-1).cast("bigint").alias("document_id"), F.lit(1.0).alias("score"))
    return topk.valid(f.candidates.select("split", "query_id", "document_id", s.alias("score")).union(padded)).select("split", "query_id", "document_id")


@query("SELECT split, shard, query_id, document_id, round(score::FLOAT::DOUBLE, 6) AS score FROM (SELECT *, document_id % 3 AS shard FROM cand) WHERE split = 'c1' AND shard = 2")
def padded_parts(f):
    """Candidates written as padded files by (split, shard), of which one is opened."""
    folder = sinks.new_folder(f.spark, "parts")
    npz.write_padded(f.candidates.withColumn("shard", F.col("document_id") % 3), folder)
    return npz.read_padded(f.spark, folder, "c1", 2).select("split", "shard", "query_id", "document_id", F.round("score", 6).alias("score"))


@query("SELECT split, document_id % 4 AS shard, count(*) AS rows, sum(round(score, 6)::DECIMAL(18, 6))::DOUBLE AS score, (document_id % 4 >= 2 OR split = 'c3')::BIGINT AS computed_late FROM cand GROUP BY ALL")
def parts_restart(f):
    """A run by shards that stopped half way, begun again: the rest is computed, what stood stays."""
    folder, late = sinks.new_folder(f.spark, "parts"), []
    shard = lambda split, n: f.candidates.where((F.col("split") == split) & (F.col("document_id") % 4 == n)).drop("split")
    parts = [(r.split, n) for r in f.splits.orderBy("split").collect() for n in range(4)]
    restart.run_parts(f.spark, folder, [p for p in parts if p[1] < 2 and p[0] != "c3"], shard)
    late = restart.run_parts(f.spark, folder, parts, shard)
    mark = f.spark.createDataFrame([(*p, int(p in late)) for p in parts], "split string, shard int, computed_late int")
    noted = restart.finished(f.spark, folder).join(mark, ["split", "shard"])
    sums = readers.read_parts(f.spark, folder).groupBy("split", "shard").agg(F.sum(F.round("score", 6).cast("decimal(18,6)")).cast("double").alias("score"))
    return noted.join(sums, ["split", "shard"]).select("split", "shard", "rows", "score", "computed_late")


def _files(f, config: str, *tables: DataFrame):
    """Tables of split c1 as its files, one each, read back with the order of their rows."""
    root = sinks.new_folder(f.spark, "files")
    for i, df in enumerate(tables):
        sinks.write_split(df.coalesce(1), f"{root}/{config}", "c1", i)
    return readers.scan_split(f.spark, root, config, "c1", ordered=True)


@query("SELECT document_id, length(CASE WHEN document_id % 2 = 1 THEN document ELSE 'again ' || coalesce(document, '') END) AS n_chars FROM fd WHERE split = 'c1'")
def first_document_wins(f):
    """Ids that stand in two files have the text of the first."""
    docs = f.documents.where("split = 'c1'").select("document_id", "document")
    again = docs.withColumn("document", F.concat(F.lit("again "), F.coalesce("document", F.lit(""))))
    found = labels.looked_up(docs.select(F.lit("c1").alias("split"), "document_id"), _files(f, "documents", docs.where("document_id % 2 = 1"), again))
    return found.select("document_id", F.length("document").alias("n_chars"))


@query("SELECT p.split, p.query_id, p.positive_id, CASE WHEN p.query_id % 20 = 0 THEN 'late ' || p.query_id ELSE coalesce(q.query, '') END AS query FROM minedpairs p JOIN fq q ON q.split = p.split AND q.query_id = p.query_id WHERE p.split = 'c1'")
def last_query_wins(f):
    """Queries that stand in two files have the text of the last in their pairs."""
    queries = f.queries.where("split = 'c1'").select("query_id", "query")
    late = queries.where("query_id % 20 = 0").withColumn("query", F.concat(F.lit("late "), F.col("query_id")))
    c1 = lambda df: df.where("split = 'c1'")
    return mining.mined_pairs(c1(f.candidates), c1(f.positives), _files(f, "queries", queries, late), fx.SKIP, fx.TOP_K).select("split", "query_id", "positive_id", "query")


def _label_files(f):
    """Labels of c1 in two files, each in descending order of document."""
    rows = f.positives.where("split = 'c1'").select("query_id", F.array("document_id", F.lit(-7)).alias("document_ids"))
    part = lambda i: rows.where(F.get("document_ids", F.lit(0)) % 10 == i).coalesce(1).sortWithinPartitions(F.get("document_ids", F.lit(0)).desc(), "query_id")
    return labels.first_element(_files(f, "labels", part(1), part(2)))


@query("SELECT query_id, gold_pos, document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id % 10, document_id DESC) AS gold_pos FROM positives WHERE split = 'c1') WHERE gold_pos <= 3")
def labels_in_files(f):
    """The first three labels of a query are those that come first in the files."""
    return labels.capped_gold(labels.in_file_order(_label_files(f)), 3).select("query_id", "gold_pos", "document_id")


@query("SELECT query_id, document_id FROM (SELECT *, row_number() OVER (ORDER BY document_id % 10, document_id DESC, query_id) AS r FROM positives WHERE split = 'c1') WHERE r <= 25")
def first_rows_in_files(f):
    return mining.first_rows(_label_files(f), 25, order=readers.FILE_ORDER).select("query_id", "document_id")


@query("SELECT document_id, substr(document, 1, 200) AS text FROM fd WHERE document IS NOT NULL")
def text_truncate(f):
    return f.documents.where("document is not null").select("document_id", text.truncated(F.col("document"), 200).alias("text"))


@query("SELECT document_id, array_to_string(string_split(document, ' ')[1:30], ' ') AS text FROM fd WHERE document IS NOT NULL")
def token_truncate(f):
    return f.documents.where("document is not null").select("document_id", text.truncated_tokens(F.col("document"), 30).alias("text"))


@query("SELECT document_id, 2::BIGINT AS n, document_id + 1 AS second FROM fd")
def list_parse(f):
    ids = text.parsed_ids(F.concat(F.lit("["), F.col("document_id"), F.lit(", "), F.col("document_id") + 1, F.lit("]")))
    return f.documents.select("document_id", ids.alias("ids")).select("document_id", F.size("ids").alias("n"), F.get("ids", F.lit(1)).alias("second"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS first FROM vec")
def l2_normalize(f):
    v = F.transform("v", lambda x: x * 3.0)
    return f.vec.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.get(vectors.l2_normalized(v), F.lit(0)), 9).alias("first"))


@query("SELECT r.split, r.query_id, r.document_id, length(d.document) AS n_chars FROM free r LEFT JOIN fd d ON d.split = r.split AND d.document_id = r.document_id WHERE r.r <= 5")
def doc_lookup(f):
    rows = topk.ranked(labels.excluded(f.candidates, f.positives).join(f.positives.select("split", "query_id").distinct(), ["split", "query_id"], "left_semi"), 5)
    return labels.looked_up(rows, f.documents).select("split", "query_id", "document_id", F.length("document").alias("n_chars"))


@query("SELECT dataset, 'qrels' AS kind, count(*) AS n, sum(rel)::BIGINT AS total FROM qrels GROUP BY dataset UNION ALL SELECT 'all', 'corpus', count(*), sum(length(trim(coalesce(lang || ' ' || text, text, ''), e' \\n\\t\\r')))::BIGINT FROM vec v LEFT JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = v.vec_id UNION ALL SELECT split, 'queries', count(*), 0 FROM fq WHERE query_id::VARCHAR IN (SELECT query_id FROM qrels) GROUP BY split")
def eval_load(f):
    names = f.table("documents").select(F.col("doc_id"), F.col("lang").alias("title"))
    corpus = f.vec.join(names, f.vec.vec_id == names.doc_id, "left").select(F.col("vec_id").alias("_id"), "title", "text")
    rels = f.qrels.select("dataset", F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score"))
    none = rels.withColumn("score", F.lit(0))
    c, q, r = readers.load_dataset(corpus, f.queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), rels.drop("dataset").union(none.drop("dataset")))
    n = F.count("*").alias("n")
    split = lambda i: F.concat(F.lit("c"), F.expr(f"(bigint({i}) div 10) % 4").cast("string"))
    out = r.groupBy(split("query_id").alias("dataset")).agg(n, F.sum("rel").alias("total")).select("dataset", F.lit("qrels").alias("kind"), "n", "total")
    out = out.union(c.agg(n, F.sum(F.length("text")).alias("total")).select(F.lit("all"), F.lit("corpus"), "n", "total"))
    return out.union(q.groupBy(split("query_id").alias("d")).agg(n).select("d", F.lit("queries"), "n", F.lit(0).cast("bigint")))


@query("SELECT r.query_id, r.doc_id, r.rel, length(coalesce(q.text, '')) AS query, length(coalesce(d.text, '')) AS document FROM qrels r JOIN vec q ON q.vec_id::VARCHAR = r.query_id JOIN vec d ON d.vec_id::VARCHAR = r.doc_id")
def eval_files(f):
    """The last snapshot of a dataset in files: the corpus as Parquet, queries as JSON lines, judgements as shards of two splits."""
    root = sinks.new_folder(f.spark, "eval")
    old, new = f"{root}/beir/snapshots/a1", f"{root}/beir/snapshots/b2"
    corpus = f.vec.select(F.col("vec_id").cast("string").alias("_id"), F.lit("").alias("title"), "text")
    corpus.where("vec_id < 0").write.parquet(f"{old}/corpus.parquet")
    corpus.write.parquet(f"{new}/corpus.parquet")
    f.vec.select(F.col("vec_id").cast("string").alias("id"), "text").write.json(f"{new}/queries.jsonl")
    rels = f.qrels.select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score"))
    sinks.write_split(rels, f"{new}/qrels", "test", compression="zstd")
    # One judgement a query: nothing may read it, and any that is read would show.
    dev = f.queries.select(F.col("query_id").cast("string").alias("query-id"), F.col("query_id").cast("string").alias("corpus-id"), F.lit(9).alias("score"))
    sinks.write_split(dev, f"{new}/qrels", "dev")
    at = readers.latest_snapshot(f.spark, root, "beir")
    c, q, r = readers.load_dataset(*[readers.read_kind(f.spark, at, kind, readers.official_split("nfcorpus")) for kind in ("corpus", "queries", "qrels")])
    x = metrics.looked_up(r, q.select("query_id", F.length("text").alias("query")), "query_id")
    x = metrics.looked_up(x, c.select("doc_id", F.length("text").alias("document")), "doc_id")
    return x.select("query_id", "doc_id", "rel", "query", "document")


# Top-k


@query("SELECT split, query_id, document_id, round(score, 6) AS score, rank FROM dcand WHERE rank <= 100")
def dense_topk(f):
    return f.search(fx.DENSE, 100).select("split", "query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT split, query_id, document_id, round(score, 6) AS score, rank FROM cand WHERE rank <= 100")
def maxsim_topk(f):
    return f.search(fx.MINER, 100).select("split", "query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT split, query_id, document_id, round(score, 6) AS score, rank, scored FROM ifound")
def index_topk(f):
    """Centroids, lists and codes written to files, read back, probed; exact scores of what the bounds leave."""
    return f.indexed.select("split", "query_id", "document_id", F.round("score", 6).alias("score"), "rank", "scored")


@query(f"SELECT e.split, count(DISTINCT e.query_id) AS queries, round(avg((i.rank IS NOT NULL)::INT::DOUBLE), 6) AS recall, round(any_value(w.scored) / any_value(n), 6) AS scored_share FROM (SELECT * FROM cand WHERE rank <= {fx.INDEX_K}) e LEFT JOIN ifound i ON i.split = e.split AND i.query_id = e.query_id AND i.document_id = e.document_id JOIN (SELECT split, avg(scored) AS scored FROM (SELECT DISTINCT split, query_id, scored FROM ifound) GROUP BY split) w ON w.split = e.split JOIN (SELECT split, count(*)::DOUBLE AS n FROM fd GROUP BY split) d ON d.split = e.split GROUP BY e.split")
def index_recall(f):
    """What the index finds of the exact top, and the share of the documents that it scores exactly."""
    x = index.recall(f.indexed, f.search(fx.MINER, fx.INDEX_K), f.documents)
    return x.select("split", "queries", F.round("recall", 6).alias("recall"), F.round("scored_share", 6).alias("scored_share"))


@query("SELECT split, query_id, document_id, round(score / 4, 6) AS score FROM cand WHERE rank <= 10")
def meanmaxsim(f):
    q, d = f.queries.select("split", "query_id", F.col("v").alias("qv")), f.documents.select("split", "document_id", F.col("v").alias("dv"))
    x = f.candidates.where("rank <= 10").join(q, ["split", "query_id"]).join(d, ["split", "document_id"])
    s = vectors.meanmaxsim(vectors.chunks(F.col("qv"), *fx.MINER), vectors.chunks(F.col("dv"), *fx.MINER))
    return x.select("split", "query_id", "document_id", F.round(s, 6).alias("score"))


@query(f"SELECT c.split, c.query_id, c.document_id, round({_maxsim('q.v', 'd.v', fx.JUDGE, 'greatest({}, 0)')}, 6) AS score FROM cand c JOIN fq q ON q.split = c.split AND q.query_id = c.query_id JOIN fd d ON d.split = c.split AND d.document_id = c.document_id WHERE c.rank <= 10")
def maxsim_padclamp(f):
    q, d = f.queries.select("split", "query_id", F.col("v").alias("qv")), f.documents.select("split", "document_id", F.col("v").alias("dv"))
    x = f.candidates.where("rank <= 10").join(q, ["split", "query_id"]).join(d, ["split", "document_id"])
    s = vectors.maxsim(vectors.chunks(F.col("qv"), *fx.JUDGE), vectors.chunks(F.col("dv"), *fx.JUDGE), floor_at_zero=True)
    return x.select("split", "query_id", "document_id", F.round(s, 6).alias("score"))


def _masked(n: int, w: int) -> str:
    seen = lambda v, i: f"list_filter(range(0, {n}), lambda {i}: {v}[{i}*{w}+1] > 0)"
    best = f"list_max(list_transform({seen('d.v', 'm')}, lambda j: list_dot_product(q.v[i*{w}+1:i*{w}+{w}], d.v[j*{w}+1:j*{w}+{w}])))"
    return f"coalesce(list_sum(list_transform({seen('q.v', 'l')}, lambda i: coalesce({best}, 0))), 0) / greatest(len({seen('q.v', 'l')}), 1)"


@query(f"SELECT c.split, c.query_id, c.document_id, round({_masked(*fx.MINER)}, 6) AS score FROM cand c JOIN fq q ON q.split = c.split AND q.query_id = c.query_id JOIN fd d ON d.split = c.split AND d.document_id = c.document_id WHERE c.rank <= 10")
def meanmaxsim_masked(f):
    """Tokens whose first component is not positive are masked on both sides, in place of skip lists and padding."""
    q, d = f.queries.select("split", "query_id", F.col("v").alias("qv")), f.documents.select("split", "document_id", F.col("v").alias("dv"))
    x = f.candidates.where("rank <= 10").join(q, ["split", "query_id"]).join(d, ["split", "document_id"])
    x = x.select("split", "query_id", "document_id", vectors.chunks(F.col("qv"), *fx.MINER).alias("q"), vectors.chunks(F.col("dv"), *fx.MINER).alias("d"))
    seen = lambda c: F.transform(c, lambda t: t[0] > 0)
    s = vectors.masked_maxsim(F.col("q"), F.col("d"), seen("q"), seen("d"), mean=True)
    return x.select("split", "query_id", "document_id", F.round(s, 6).alias("score"))


#: Words of a skip list.
_SKIP = ["de", "the", "and", "la", "die", "der", "of", "le"]


@query(f"SELECT c.split, c.query_id, c.document_id, round(list_sum(list_transform(range(0, 4), lambda i: coalesce(list_max(list_transform(list_filter(range(0, 4), lambda m: d.w[m+1] IS NOT NULL AND NOT list_contains({_SKIP}, d.w[m+1])), lambda j: list_dot_product(q.v[i*16+1:i*16+16], d.v[j*16+1:j*16+16]))), 0))) / 4, 6) AS score FROM cand c JOIN fq q ON q.split = c.split AND q.query_id = c.query_id JOIN (SELECT *, CASE WHEN document IS NOT NULL THEN string_split(document, ' ')[1:4] ELSE [] END AS w FROM fd) d ON d.split = c.split AND d.document_id = c.document_id WHERE c.rank <= 10")
def meanmaxsim_skiplist(f):
    """A document's first four words name its token vectors: those in a skip list and those that are missing are masked. Queries are expanded, so all their tokens count."""
    n = fx.MINER[0]
    q, d = f.queries.select("split", "query_id", F.col("v").alias("qv")), f.documents.select("split", "document_id", F.col("v").alias("dv"), F.split("document", " ").alias("w"))
    x = f.candidates.where("rank <= 10").join(q, ["split", "query_id"]).join(d, ["split", "document_id"])
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.col("w"), i))
    x = x.select("split", "query_id", "document_id", vectors.chunks(F.col("qv"), *fx.MINER).alias("q"), vectors.chunks(F.col("dv"), *fx.MINER).alias("d"), vectors.skiplist_mask(words, _SKIP).alias("mask"))
    return x.select("split", "query_id", "document_id", F.round(vectors.masked_maxsim(F.col("q"), F.col("d"), None, F.col("mask"), mean=True), 6).alias("score"))


def _parts(f):
    """Candidates of two overlapping shards: even and odd places, and the first ten in both."""
    s = f.candidates.select("split", "query_id", "document_id", "score", "rank")
    return s.select("*", (F.col("rank") % 2).alias("shard")).union(s.where("rank <= 10").select("*", ((F.col("rank") + 1) % 2).alias("shard"))).drop("rank")


_PARTS = "(SELECT split, query_id, document_id, score, rank % 2 AS shard FROM cand UNION ALL SELECT split, query_id, document_id, score, (rank + 1) % 2 FROM cand WHERE rank <= 10)"


@query(f"SELECT split, query_id, document_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY round(score, 9) DESC, document_id, shard) AS rank FROM {_PARTS}) WHERE rank <= 50")
def merge_shards(f):
    return topk.merged(_parts(f), 50).select("split", "query_id", "document_id", "rank")


@query("SELECT split, query_id, document_id, rank FROM cand WHERE rank <= 50")
def ablation_merge(f):
    return topk.merged_best(_parts(f), 50).select("split", "query_id", "document_id", "rank")


# Labels, mining, pairs


@query("SELECT split, query_id, document_id, label_pos FROM positives")
def positives_distinct(f):
    again = f.positives.withColumn("label_pos", F.col("label_pos") + 100)
    return labels.distinct_positives(f.positives.union(again)).select("split", "query_id", "document_id", "label_pos")


@query("SELECT split, query_id, document_id, label_pos AS gold_pos FROM positives WHERE label_pos <= 3")
def judge_gold(f):
    return labels.capped_gold(f.positives, 3).select("split", "query_id", "document_id", "gold_pos")


@query("SELECT split, query_id, document_id, neg_rank FROM mined")
def mine_negatives(f):
    return mining.mined_negatives(f.candidates, f.positives, fx.SKIP, fx.TOP_K)


@query("SELECT p.split, p.query_id, p.positive_id, m.ids AS negative_ids FROM minedpairs p JOIN (SELECT split, query_id, string_agg(document_id::VARCHAR, ',' ORDER BY neg_rank) AS ids FROM mined GROUP BY ALL) m ON m.split = p.split AND m.query_id = p.query_id")
def pairs(f):
    return f.pairs.select("split", "query_id", "positive_id", F.array_join("negative_ids", ",").alias("negative_ids"))


@query("SELECT split, query_id, positive_id FROM minedpairs WHERE split IN ('c0', 'c2')")
def scan_pairs(f):
    """Pairs as JSON lines and back, for two splits."""
    lines = sinks.json_rows(f.pairs, "query_id", "split", "query", "positive_id", "negative_ids")
    return lines.select(F.from_json("json", schema.PAIRS).alias("r")).select("r.*").where(F.col("split").isin("c0", "c2")).select("split", "query_id", "positive_id")


_PAIR_STATS = "SELECT p.split, coalesce(sum(CASE WHEN kept THEN np ELSE 0 END), 0)::BIGINT AS pairs_written, count(*) FILTER (WHERE kept) AS queries, count(*) FILTER (WHERE kept AND np > 1) AS multi_positive_queries, coalesce(sum(CASE WHEN there AND NOT kept THEN np ELSE 0 END), 0)::BIGINT AS pairs_dropped_short_of_k, count(*) FILTER (WHERE NOT there) AS queries_without_candidates FROM (SELECT split, query_id, count(*) AS np, (split, query_id) IN (SELECT split, query_id FROM mined) AS kept, (split, query_id) IN (SELECT split, query_id FROM cand) AS there FROM positives GROUP BY split, query_id) p GROUP BY p.split"


@query(_PAIR_STATS)
def pairs_stats(f):
    return mining.pair_stats(f.candidates, f.positives, fx.SKIP, fx.TOP_K)


@query(f"SELECT s.*, t.rows FROM ({_PAIR_STATS}) s JOIN (SELECT split, count(*) AS rows FROM minedpairs GROUP BY split) t ON t.split = s.split")
def pairs_written(f):
    """Pairs written as JSON lines, with the counts observed on the way in a file beside them; both are read back."""
    path = sinks.new_folder(f.spark, "pairs")
    mining.write_pairs(f.candidates, f.positives, f.queries, path, [r.split for r in f.splits.collect()], fx.SKIP, fx.TOP_K)
    names = ["pairs_written", "queries", "multi_positive_queries", "pairs_dropped_short_of_k", "queries_without_candidates"]
    meta = f.spark.read.text(f"{path}.meta.json", wholetext=True).select(F.from_json("value", f"per_split map<string, struct<{', '.join(f'{n}: bigint' for n in names)}>>").alias("m"))
    stats = meta.select(F.explode("m.per_split").alias("split", "x")).select("split", "x.*")
    return stats.join(readers.read_pairs(f.spark, path).groupBy("split").agg(F.count("*").alias("rows")), "split")


@query("SELECT to_json({'query_id': p.query_id, 'split': p.split, 'positive_id': p.positive_id, 'negative_ids': m.ids})::VARCHAR AS json FROM minedpairs p JOIN (SELECT split, query_id, list(document_id ORDER BY neg_rank) AS ids FROM mined GROUP BY ALL) m ON m.split = p.split AND m.query_id = p.query_id")
def to_json_rows(f):
    return sinks.json_rows(f.pairs, "query_id", "split", "positive_id", "negative_ids")


#: A text as a JSON string in ASCII; one letter becomes an emoji, another a backslash, so that there are some.
_ASCII = "'\"' || array_to_string(list_transform(regexp_extract_all({}, '(?s).'), lambda c: CASE c WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(8) THEN '\\b' WHEN chr(9) THEN '\\t' WHEN chr(10) THEN '\\n' WHEN chr(12) THEN '\\f' WHEN chr(13) THEN '\\r' ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN format('\\u{{:04x}}', unicode(c)) ELSE format('\\u{{:04x}}\\u{{:04x}}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END END), '') || '\"'"
_MARKED = ("ns", "😀\\")


@query("SELECT '{\"query_id\": ' || p.query_id || ', \"split\": \"' || p.split || '\", \"query\": ' || " + _ASCII.format(f"translate(coalesce(q.query, ''), '{_MARKED[0]}', '{_MARKED[1]}')") + " || ', \"positive_id\": ' || p.positive_id || ', \"negative_ids\": [' || array_to_string(m.ids, ', ') || ']}' AS json FROM minedpairs p JOIN fq q ON q.split = p.split AND q.query_id = p.query_id JOIN (SELECT split, query_id, list(document_id ORDER BY neg_rank) AS ids FROM mined GROUP BY ALL) m ON m.split = p.split AND m.query_id = p.query_id")
def ascii_json_lines(f):
    """Pairs written as JSON lines in ASCII, and the lines read back."""
    path = sinks.new_folder(f.spark, "ascii")
    lists_ = mining.query_lists(f.candidates, f.positives, f.queries, fx.SKIP, fx.TOP_K).withColumn("query", F.translate("query", *_MARKED))
    sinks.write_lines(mining.pair_lines(f.positives, lists_, sinks.ascii_fields), path, "lz4")
    return f.spark.read.text(path).withColumnRenamed("value", "json")


# Judging, veto, band


@query("SELECT split, query_id FROM elig")
def judge_eligible(f):
    return f.judge_eligible


@query("SELECT split, query_id, document_id, rank FROM jcand")
def judge_candidates(f):
    return f.judge_candidates


@query("SELECT split, query_id, section, document_id, rank, round(judge_score, 6) AS judge_score FROM pool")
def judge_pool(f):
    return f.pool.select("split", "query_id", "section", "document_id", "rank", F.round("judge_score", 6).alias("judge_score"))


@query("SELECT split, query_id, CASE WHEN query_id % 20 = 0 THEN 1 ELSE 0 END::BIGINT AS shard, count(*) AS n FROM pool GROUP BY ALL")
def judge_pool_latest(f):
    parts = f.pool.select("split", "query_id", "document_id", F.lit(0).alias("shard"))
    parts = parts.union(f.pool.where("query_id % 20 = 0").select("split", "query_id", "document_id", F.lit(1)))
    return judging.latest(parts).groupBy("split", "query_id", "shard").agg(F.count("*").alias("n"))


@query("SELECT split, query_id, positive_id, document_id, round(positive_score, 6) AS positive_score, round(score, 6) AS score FROM judged")
def pair_candidates(f):
    return f.judged.select("split", "query_id", "positive_id", "document_id", F.round("positive_score", 6).alias("positive_score"), F.round("score", 6).alias("score"))


@query("SELECT * FROM risks")
def judge_veto_risk(f):
    return f.risk


@query("SELECT split, query_id, positive_id, round(positive_score, 6) AS positive_score, survivors, pool_size FROM usable")
def usable_pairs(f):
    return f.usable.select("split", "query_id", "positive_id", F.round("positive_score", 6).alias("positive_score"), "survivors", "pool_size")


@query(f"SELECT split, query_id, positive_id, round(max(positive_score), 6) AS positive_score, count(*) AS survivors, count(*) AS pool_size FROM judged GROUP BY split, query_id, positive_id HAVING count(*) >= {fx.NEGATIVES}")
def usable_pairs_unfiltered(f):
    x = judging.usable_pairs(judging.band_pool(f.judged, fx.NEGATIVES, fx.BAND, unfiltered=True))
    return x.select("split", "query_id", "positive_id", F.round("positive_score", 6).alias("positive_score"), "survivors", "pool_size")


@query("SELECT split, query_id, positive_id, document_id, round(ratio, 6) AS ratio, pool_rank FROM band")
def band_pool(f):
    return f.band.select("split", "query_id", "positive_id", "document_id", F.round("ratio", 6).alias("ratio"), "pool_rank")


@query("SELECT split, usable_pairs, round(risk, 9) AS risk, round(weight, 9) AS weight, round(exact, 6) AS exact, target FROM goals")
def mixture_targets(f):
    return f.targets.select("split", "usable_pairs", F.round("risk", 9).alias("risk"), F.round("weight", 9).alias("weight"), F.round("exact", 6).alias("exact"), "target")


@query("SELECT split, query_id, positive_id, copy_no FROM sampledrows")
def sampled_rows(f):
    return f.sampled


@query("SELECT split, query_id, positive_id, copy_no, " + ", ".join(f"max(document_id) FILTER (WHERE slot = {i}) AS negative_{i}" for i in range(1, 8)) + " FROM sft GROUP BY split, query_id, positive_id, copy_no")
def sft_rows(f):
    return mixture.wide(f.sft, ["split", "query_id", "positive_id", "copy_no"], fx.NEGATIVES)


@query(f"SELECT g.split, g.usable_pairs, g.target, coalesce(n, 0)::BIGINT AS written, (g.target - coalesce(n, 0))::BIGINT AS skipped, round(coalesce(n, 0)::DOUBLE / greatest(g.usable_pairs, 1)::DOUBLE, 6) AS upsample FROM goals g LEFT JOIN (SELECT split, count(*) AS n FROM (SELECT split, query_id, positive_id, copy_no FROM sft s WHERE (split, document_id) IN (SELECT * FROM textdocs) AND (split, positive_id) IN (SELECT * FROM textdocs) GROUP BY ALL HAVING count(*) = {fx.NEGATIVES}) GROUP BY split) x ON x.split = g.split")
def prepare_stats(f):
    done = mixture.with_texts(f.sft, f.documents, fx.NEGATIVES).select("split", "query_id", "positive_id", "copy_no").distinct().groupBy("split").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return f.targets.join(done, "split", "left").select("split", "usable_pairs", "target", n.alias("written"), (F.col("target") - n).alias("skipped"), F.round(n / F.greatest("usable_pairs", F.lit(1)), 6).alias("upsample"))


@query("SELECT split AS source, count(*) AS rows, 7::BIGINT AS n_negatives, (sum(count(*)) OVER ())::BIGINT AS total, (16 * 8 - 1)::BIGINT AS in_batch_negatives FROM sampledrows GROUP BY split")
def sft_source_stats(f):
    wide = mixture.wide(f.sft, ["split", "query_id", "positive_id", "copy_no"], fx.NEGATIVES)
    k = len(readers.negatives(wide))
    x = wide.groupBy(F.col("split").alias("source")).agg(F.count("*").alias("rows"))
    return x.select("source", "rows", F.lit(k).alias("n_negatives"), F.sum("rows").over(W.partitionBy(F.lit(0))).alias("total"), F.lit(16 * (1 + k) - 1).alias("in_batch_negatives"))


@query(f"SELECT source, batch_in_source, dense_rank() OVER (ORDER BY md5('{fx.SEED}|' || source || '|' || batch_in_source), source) - 1 AS batch_order, count(*) AS rows FROM (SELECT split AS source, (row_number() OVER (PARTITION BY split ORDER BY query_id, positive_id, copy_no) - 1) // 16 AS batch_in_source FROM sampledrows) GROUP BY source, batch_in_source")
def batch_plan(f):
    x = mixture.batch_plan(f.sampled.withColumnRenamed("split", "source"), "source", ["query_id", "positive_id", "copy_no"], 16, fx.SEED)
    return x.groupBy("source", "batch_in_source", "batch_order").agg(F.count("*").alias("rows"))


@query(f"WITH b AS (SELECT u.split, u.query_id, u.positive_id, row_number() OVER (ORDER BY u.split, u.query_id, u.positive_id) - 1 AS i FROM usable u), picked AS (SELECT *, i // 16 AS batch FROM b), docs AS (SELECT i, batch, 0 AS slot, split, positive_id AS document_id FROM picked UNION ALL SELECT p.i, p.batch, n.pool_rank, p.split, n.document_id FROM picked p JOIN band n ON n.split = p.split AND n.query_id = p.query_id AND n.positive_id = p.positive_id WHERE n.pool_rank <= 7), s AS (SELECT p.i, (d.i = p.i AND d.slot = 0) AS own, {_maxsim('q.v', 'e.v', fx.MINER)} / 4 / 0.001::DOUBLE AS l FROM picked p JOIN fq q ON q.split = p.split AND q.query_id = p.query_id JOIN docs d ON d.batch = p.batch JOIN fd e ON e.split = d.split AND e.document_id = d.document_id), m AS (SELECT *, max(l) OVER (PARTITION BY i) AS top FROM s) SELECT count(*) AS n, round(avg(x), 6) AS loss FROM (SELECT i, max(top) + ln(sum(exp(l - top))) - max(l) FILTER (WHERE own) AS x FROM m GROUP BY i)")
def infonce_inbatch(f):
    """Mean contrastive loss over all batches of 16 pairs: every query against all positives and negatives of its batch."""
    picked = shards.numbered(f.usable.select(*judging.PAIR), *judging.PAIR, by=()).select(F.col("at").alias("i"), F.floor(F.col("at") / 16).alias("batch"), *judging.PAIR)
    negs = picked.join(f.band.where("pool_rank <= 7"), list(judging.PAIR)).select("i", "batch", "split", "document_id", F.col("pool_rank").alias("slot"))
    docs = picked.select("i", "batch", "split", F.col("positive_id").alias("document_id"), F.lit(0).alias("slot")).union(negs)
    docs = docs.join(f.documents.select("split", "document_id", F.col("v").alias("dv")), ["split", "document_id"]).select(F.col("i").alias("j"), "batch", "slot", "dv")
    x = picked.join(f.queries.select("split", "query_id", F.col("v").alias("qv")), ["split", "query_id"]).select("i", "batch", "qv").join(docs, "batch")
    s = vectors.meanmaxsim(vectors.chunks(F.col("qv"), *fx.MINER), vectors.chunks(F.col("dv"), *fx.MINER)) / F.lit(0.001)
    rows = x.select("i", s.alias("l"), ((F.col("i") == F.col("j")) & (F.col("slot") == 0)).alias("own"))
    per = rows.groupBy("i").agg((vectors.logsumexp(F.collect_list("l")) - F.max(F.when(F.col("own"), F.col("l")))).alias("x"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("loss"))


# Ablation and audits


@query("SELECT split, query_id, positive_id, source, neg_rank, document_id FROM arms")
def ablation_pairs(f):
    return f.ablation.select("split", "query_id", "positive_id", "source", "neg_rank", "document_id")


def _audited(f):
    """Negatives are scored once a query, positives once a pair; texts that are missing have no score."""
    arms = sinks.staged(mining.ablation_arms(f.candidates, f.dense, f.positives, f.queries, 10), "arms")
    q = f.queries.select("split", "query_id", F.col("v").alias("qv"))
    d = f.documents.select("split", "document_id", F.when(text.filled(F.col("document")), F.col("v")).alias("dv"))
    scored = topk.rescored(arms.join(q, ["split", "query_id"]).join(d, ["split", "document_id"], "left"), "qv", "dv", fx.TEACHER[0], "score")
    pairs = labels.distinct_positives(f.positives).join(arms.select("split", "query_id").distinct(), ["split", "query_id"], "left_semi")
    own = topk.pair_scores(pairs, f.queries, d.withColumnRenamed("dv", "v"), fx.TEACHER[0], "positive_score")
    return audits.mining_audit_by_query(scored, own, 10)


@query("SELECT * FROM audit")
def audit_negatives(f):
    return _audited(f)


@query("SELECT sum(n)::BIGINT AS n, round(sum(mv_false_negative_rate * n) / sum(n), 6) AS mv_false_negative_rate, round(sum(dense_false_negative_rate * n) / sum(n), 6) AS dense_false_negative_rate, round(sum(set_overlap * n) / sum(n), 6) AS set_overlap FROM audit HAVING count(*) > 0")
def audit_weighted(f):
    return audits.weighted(_audited(f), "n", ["mv_false_negative_rate", "dense_false_negative_rate", "set_overlap"])


@query("SELECT split, query_id, positive_id FROM minedpairs QUALIFY row_number() OVER (PARTITION BY split ORDER BY query_id, positive_id) <= 5")
def audit_sample(f):
    return mining.first_rows(f.pairs, 5).select("split", "query_id", "positive_id")


def _gate(pool: str) -> str:
    return f"(SELECT split, count(*) AS rows, round(sum(f)::DOUBLE / sum(k), 4) AS fn_rate, round(avg((top < p)::INT::DOUBLE), 4) AS pos_at_1, round(avg(round(p - top, 12)), 4) AS margin FROM (SELECT b.split, b.query_id, b.positive_id, count(*) FILTER (WHERE b.t > b.p) AS f, count(*) AS k, max(b.t) AS top, max(b.p) AS p FROM (SELECT x.split, x.query_id, x.positive_id, {_maxsim('q.v', 'd.v', fx.TEACHER)} AS t, {_maxsim('q.v', 'e.v', fx.TEACHER)} AS p FROM {pool} x JOIN fq q ON q.split = x.split AND q.query_id = x.query_id JOIN fd d ON d.split = x.split AND d.document_id = x.document_id JOIN fd e ON e.split = x.split AND e.document_id = x.positive_id WHERE x.pool_rank <= {fx.NEGATIVES}) b GROUP BY ALL) GROUP BY split)"


_OPEN = f"(SELECT *, row_number() OVER (PARTITION BY split, query_id, positive_id ORDER BY round(score, 9) DESC, document_id) AS pool_rank, count(*) OVER (PARTITION BY split, query_id, positive_id) AS m FROM judged QUALIFY m >= {fx.NEGATIVES})"


def _gated(f, pool):
    """Negatives and positives are scored in one pass, the positive at rank 0."""
    rows = pool.where(F.col("pool_rank") <= fx.NEGATIVES).select(*judging.PAIR, "document_id", "pool_rank")
    own = rows.where("pool_rank = 1").withColumn("document_id", F.col("positive_id")).withColumn("pool_rank", F.lit(0))
    scored = f.scored(rows.unionByName(own), fx.TEACHER, "t")
    member = F.when(F.col("pool_rank") > 0, F.struct("pool_rank", "t"))
    lists_ = scored.groupBy(*judging.PAIR).agg(F.max(F.when(F.col("pool_rank") == 0, F.col("t"))).alias("pos"), F.transform(F.array_sort(F.collect_list(member)), lambda r: r["t"]).alias("neg"))
    return audits.gate_audit(lists_.where("pos is not null and size(neg) > 0").select("split", "pos", "neg"))


@query(f"SELECT * FROM {_gate('band')}")
def gate_audit(f):
    return _gated(f, f.band)


@query(f"SELECT dir, sum(rows)::BIGINT AS rows, round(sum(fn_rate * rows) / sum(rows), 6) AS fn_rate, round(sum(pos_at_1 * rows) / sum(rows), 6) AS pos_at_1 FROM (SELECT 'filtered' AS dir, * FROM {_gate('band')} UNION ALL SELECT 'unfiltered', * FROM {_gate(_OPEN)}) GROUP BY dir")
def gate_compare(f):
    open_pool = judging.band_pool(f.judged, fx.NEGATIVES, fx.BAND, unfiltered=True)
    both = _gated(f, f.band).withColumn("dir", F.lit("filtered")).unionByName(_gated(f, open_pool).withColumn("dir", F.lit("unfiltered")))
    return audits.weighted(both, "rows", ["fn_rate", "pos_at_1"], ["dir"])


@query(f"SELECT coalesce(a.split, b.split) AS split, a.fn_rate AS filtered_fn_rate, a.pos_at_1 AS filtered_pos_at_1, b.fn_rate AS unfiltered_fn_rate, b.pos_at_1 AS unfiltered_pos_at_1 FROM (SELECT * FROM {_gate('band')} WHERE split <> 'c2') a FULL JOIN {_gate(_OPEN)} b ON a.split = b.split")
def gate_pivot(f):
    """Splits against directories; the filtered one lacks a split."""
    open_pool = judging.band_pool(f.judged, fx.NEGATIVES, fx.BAND, unfiltered=True)
    both = _gated(f, f.band.where("split <> 'c2'")).withColumn("dir", F.lit("filtered")).unionByName(_gated(f, open_pool).withColumn("dir", F.lit("unfiltered")))
    return audits.pivoted(both, "dir", ["filtered", "unfiltered"], ["fn_rate", "pos_at_1"])


def _share(c: str, width: int) -> str:
    return f"lpad(printf('%.1f', {c} * 100), {width}, ' ') || '%'"


_NAMED = ("mv_false_negative_rate", "dense_false_negative_rate", "mv_mean_negative_score", "dense_mean_negative_score", "set_overlap")


@query("SELECT row_number() OVER (ORDER BY part, split) AS line_no, CASE WHEN part = 1 THEN repeat('-', 74) ELSE rpad(split, 10, ' ') || ' ' || lpad(n::VARCHAR, 4, ' ') || ' | ' || " + f"{_share(_NAMED[0], 7)} || ' ' || {_share(_NAMED[1], 10)} || ' | ' || lpad(printf('%.3f', {_NAMED[2]}), 8, ' ') || ' ' || lpad(printf('%.3f', {_NAMED[3]}), 10, ' ') || ' | ' || {_share(_NAMED[4], 6)}" + " END AS line FROM (SELECT 0 AS part, * FROM audit UNION ALL SELECT unnest([1, 2]), 'WEIGHTED', sum(n), " + ", ".join(f"sum({c} * n) / sum(n)" for c in _NAMED) + " FROM audit HAVING count(*) > 0)")
def audit_lines(f):
    """The audit of negatives as printed lines."""
    return audits.mining_lines(sinks.staged(_audited(f), "audited"))


@query(f"WITH a AS (SELECT 'filtered' AS dir, * FROM {_gate('band')} WHERE split <> 'c2'), b AS (SELECT 'unfiltered' AS dir, * FROM {_gate(_OPEN)}) SELECT row_number() OVER (ORDER BY part, key) AS line_no, line FROM (SELECT 0 AS part, '' AS key, rpad('split', 10, ' ') || lpad('filtered', 24, ' ') || lpad('unfiltered', 24, ' ') AS line UNION ALL SELECT 1, coalesce(a.split, b.split), rpad(coalesce(a.split, b.split), 10, ' ') || CASE WHEN a.split IS NULL THEN repeat(' ', 24) ELSE {_share('a.fn_rate', 9)} || ' fn ' || {_share('a.pos_at_1', 5)} || '@1' END || CASE WHEN b.split IS NULL THEN repeat(' ', 24) ELSE {_share('b.fn_rate', 9)} || ' fn ' || {_share('b.pos_at_1', 5)} || '@1' END FROM a FULL JOIN b ON a.split = b.split UNION ALL SELECT 2, dir, 'WEIGHTED ' || rpad(dir, 24, ' ') || ' fn=' || printf('%.1f', sum(fn_rate * rows) / sum(rows) * 100) || '%  pos@1=' || printf('%.1f', sum(pos_at_1 * rows) / sum(rows) * 100) || '%' FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY dir)")
def gate_lines(f):
    """Both directories' audits as printed lines; the filtered one lacks a split."""
    open_pool = judging.band_pool(f.judged, fx.NEGATIVES, fx.BAND, unfiltered=True)
    both = _gated(f, f.band.where("split <> 'c2'")).withColumn("dir", F.lit("filtered")).unionByName(_gated(f, open_pool).withColumn("dir", F.lit("unfiltered")))
    return audits.gate_lines(sinks.staged(both, "gates"), ["filtered", "unfiltered"])


# Distillation lists and losses


@query("SELECT query_id, pos, document_id, section FROM kd")
def kd_lists(f):
    return f.lists.select("query_id", "pos", "document_id", "section")


@query("SELECT query_id, pos, document_id FROM kd QUALIFY dense_rank() OVER (PARTITION BY split ORDER BY query_id) <= 3")
def kd_lists_capped(f):
    return lists.candidate_lists(f.pool, f.split_index, fx.WIDTH, cap=3).select("query_id", "pos", "document_id")


@query("SELECT query_id, string_agg(document_id::VARCHAR, ',' ORDER BY pos) AS document_ids FROM kd WHERE pos <= 16 GROUP BY query_id")
def kd_fixed_width(f):
    return lists.fixed_width(lists.packed(f.lists), 16).select("query_id", F.array_join("document_ids", ",").alias("document_ids"))


@query("SELECT DISTINCT split, document_id FROM kd")
def kd_docs(f):
    return lists.used_documents(f.lists)


@query("SELECT p.split, coalesce(k.n, 0)::BIGINT AS rows, (p.n - coalesce(k.n, 0))::BIGINT AS dropped_short, coalesce(k.m, 0)::BIGINT AS documents FROM (SELECT split, count(DISTINCT query_id) AS n FROM pool GROUP BY split) p LEFT JOIN (SELECT split, count(DISTINCT query_id) AS n, count(DISTINCT document_id) AS m FROM kd GROUP BY split) k ON k.split = p.split")
def kd_stats(f):
    return lists.list_stats(f.pool, f.lists)


@query("SELECT k.query_id, k.pos, length(d.document) AS n_chars FROM kd k JOIN fd d ON d.split = k.split AND d.document_id = k.d")
def kd_texts(f):
    texts = f.documents.select("split", F.col("document_id").alias("d"), "document")
    x = f.lists.withColumn("d", F.col("document_id") % shards.NAMESPACE).join(texts, ["split", "d"])
    return x.select("query_id", "pos", F.length("document").alias("n_chars"))


@query("SELECT query_id, pos, document_id, round(teacher, 6) AS teacher FROM kdscores")
def teacher_scores(f):
    return f.list_scores.select("query_id", "pos", "document_id", F.round("teacher", 6).alias("teacher"))


@query("SELECT query_id, pos, round(teacher, 5) AS score FROM kdscores")
def teacher_swap(f):
    """Two shards of teacher rows, the later one right."""
    t = f.score_rows.select("query_id", "teacher")
    right = t.select("query_id", "teacher", F.lit(1).alias("shard"))
    wrong = t.select("query_id", F.transform("teacher", lambda x: x * 0.0), F.lit(0))
    swapped = lists.swapped_teacher(lists.packed(f.lists), right.union(wrong).withColumnRenamed("teacher", "scores"))
    return swapped.select("query_id", F.posexplode("scores").alias("pos", "score")).select("query_id", (F.col("pos") + 1).alias("pos"), F.round("score", 5).alias("score"))


def _list_rows(scored):
    return scored.select("query_id", F.posexplode(F.arrays_zip("document_ids", "scores")).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("pos"), F.col("x.document_ids").alias("document_id"), F.col("x.scores").cast("double").alias("score"))


def _cells(f, column):
    """Queries and documents in the lists' id space, with `column` of each as cell."""
    own = lambda df, key, c: df.join(f.split_index, "split").select(shards.namespaced(F.col("split_index"), F.col(key)).alias(key), c.alias("cell"))
    return own(f.queries, "query_id", column("query")), own(f.documents, "document_id", column("document"))


@query("SELECT query_id, pos, document_id, round(score::FLOAT::DOUBLE, 5) AS score FROM kdatt")
def listwise_scores(f):
    """Each document is scored with those before it in its list."""
    scored = listwise.list_scores(lists.packed(f.lists), *_cells(f, lambda side: F.col("v")), listwise.attention, fx.WIDTH)
    return _list_rows(scored).withColumn("score", F.round("score", 5))


@query("SELECT k.query_id, k.pos, k.document_id, count(m.t)::DOUBLE AS score FROM kd k LEFT JOIN (SELECT query_id, t, min(pos) AS pos FROM kdword GROUP BY query_id, t) m ON m.query_id = k.query_id AND m.pos = k.pos GROUP BY ALL")
def listwise_texts(f):
    """A list scorer over cut texts: tokens of the query that no earlier document of the list holds."""
    most = {"query": listwise.QUERY_TOKENS, "document": listwise.DOCUMENT_TOKENS}
    cells = _cells(f, lambda side: F.coalesce(text.truncated_tokens(F.col(side), most[side]), F.lit("")))
    return _list_rows(listwise.list_scores(lists.packed(f.lists), *cells, listwise.newly_covered, fx.WIDTH))


@query("SELECT query_id, pos, round(score::FLOAT::DOUBLE, 5) AS score FROM kdatt")
def listwise_restart(f):
    """Lists scored in three shards, each written once; a run begun again takes the finished ones. The scores then replace the lists' placeholders."""
    packed, cells = lists.packed(f.lists), _cells(f, lambda side: F.col("v"))
    dealt = sinks.staged(shards.proportional(packed.select("query_id", "document_ids"), "query_id", 3, by=()), "dealt")
    path = sinks.new_folder(f.spark, "listwise")
    score = lambda split, shard: listwise.list_scores(dealt.where(F.col("shard") == shard), *cells, listwise.attention, fx.WIDTH)
    restart.run_parts(f.spark, path, [("train", 0), ("train", 2)], score)
    restart.run_parts(f.spark, path, [("train", i) for i in range(3)], score)
    swapped = lists.swapped_teacher(packed, readers.read_parts(f.spark, path, "train", "query_id bigint, scores array<float>, split string, shard int").select("query_id", "scores", "shard"))
    return swapped.select("query_id", F.posexplode("scores").alias("pos", "score")).select("query_id", (F.col("pos") + 1).alias("pos"), F.round(F.col("score").cast("double"), 5).alias("score"))


@query("SELECT query_id, pos, round(t, 6) AS scaled FROM kdscaled")
def row_minmax(f):
    return f.score_rows.select("query_id", F.posexplode(vectors.minmax(F.col("teacher"))).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("pos"), F.round("x", 6).alias("scaled"))


@query("SELECT k.query_id, k.pos, round(least(greatest(k.teacher, q.low), q.high), 6) AS clipped FROM kdscores k JOIN (SELECT query_id, quantile_cont(teacher, 0.05) AS low, quantile_cont(teacher, 0.95) AS high FROM kdscores GROUP BY query_id) q ON q.query_id = k.query_id")
def row_clip(f):
    rows = f.score_rows
    x = rows.join(losses.row_quantiles(rows, "query_id", "teacher", 0.05), "query_id")
    return x.select("query_id", F.posexplode(vectors.clipped(F.col("teacher"), F.col("low"), F.col("high"))).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("pos"), F.round("x", 6).alias("clipped"))


@query("SELECT query_id, round(kl, 6) AS kl FROM kdloss")
def kd_kl(f):
    return f.score_rows.select("query_id", F.round(losses.kl(vectors.minmax(F.col("teacher")), vectors.minmax(F.col("student"))), 6).alias("kl"))


@query("SELECT query_id, round(nce, 6) AS nce FROM kdloss")
def kd_nce(f):
    return f.score_rows.select("query_id", F.round(losses.nce(vectors.minmax(F.col("teacher")), vectors.minmax(F.col("student"))), 6).alias("nce"))


@query("SELECT count(*) AS n, round(avg(kl), 6) AS kl, round(avg(nce), 6) AS nce, round(avg(kl) + 0.1::DOUBLE * avg(nce), 6) AS loss FROM kdloss")
def kd_mixed_loss(f):
    return losses.mixed_loss(f.score_rows).select("n", *[F.round(c, 6).alias(c) for c in ("kl", "nce", "loss")])


@query("SELECT count(*) AS n, round(sum(kl), 6) AS kl, round(avg(nce), 6) AS nce, round(sum(kl) + 0.1::DOUBLE * avg(nce), 6) AS loss FROM kdloss HAVING count(*) > 0")
def kd_summed_loss(f):
    """The divergences summed up, not averaged."""
    return losses.mixed_loss(f.score_rows, size_average=False).where("n > 0").select("n", *[F.round(c, 6).alias(c) for c in ("kl", "nce", "loss")])


# Third-party triples


@query("SELECT row_id, neg_no, pos_score, neg_score, survives, survivors, kept FROM vetoed")
def bica_veto(f):
    return f.vetoed


@query("SELECT usable, negatives_in, negatives_vetoed, short, round(risk, 9) AS risk, target FROM ttarget")
def bica_target(f):
    return mixture.triple_target(f.vetoed).select("usable", "negatives_in", "negatives_vetoed", "short", F.round("risk", 9).alias("risk"), "target")


@query(f"SELECT cycle, row_id, neg_no, row_number() OVER (PARTITION BY cycle, row_id ORDER BY md5('{fx.SEED}|' || cycle || '|' || row_id || '|' || neg_no), neg_no) AS slot FROM (SELECT r.row_id, unnest(range(0, (t.target - 1 - r.at) // t.usable + 1)) AS cycle FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS at FROM (SELECT DISTINCT row_id FROM vetoed WHERE kept)) r, ttarget t WHERE t.target > r.at) c JOIN (SELECT row_id, neg_no FROM vetoed WHERE kept AND survives) v USING (row_id) QUALIFY slot <= {fx.NEGATIVES}")
def bica_rows(f):
    vetoed = sinks.staged(f.vetoed, "vetoed")
    return mixture.upsampled_triples(vetoed, mixture.triple_target(vetoed), fx.NEGATIVES, fx.SEED)


# The stages as commands, over files


def _staged(f, stage: str, out: str, kinds: list[str], *options: str) -> str:
    """Runs a stage over the fixtures' files, of the kinds that it reads; gives the folder it wrote."""
    path = f"{sinks.new_folder(f.spark, stage)}/{out}"
    splits = ",".join(sorted(r.split for r in f.splits.collect()))
    root = f.files(*kinds)
    stages.run(f.spark, [stage, "--splits", splits, *[o.format(root=root, out=path) for o in options]])
    return path


@query("SELECT p.split, p.query_id, p.positive_id, coalesce(q.query, '') AS query, m.ids AS negatives FROM minedpairs p JOIN fq q ON q.split = p.split AND q.query_id = p.query_id JOIN (SELECT split, query_id, string_agg(document_id::VARCHAR, ',' ORDER BY neg_rank) AS ids FROM mined GROUP BY ALL) m ON m.split = p.split AND m.query_id = p.query_id")
def stage_merge_pairs(f):
    path = _staged(f, "merge-pairs", "pairs.jsonl", ["queries", "scores", "parts"], "--data-root", "{root}", "--work-dir", "{root}", "--out", "{out}")
    return readers.read_pairs(f.spark, path).select("split", "query_id", "positive_id", "query", F.array_join("negative_ids", ",").alias("negatives"))


@query("SELECT split, query_id, positive_id, string_agg(document_id::VARCHAR || source, ',' ORDER BY source DESC, neg_rank) AS negatives FROM arms GROUP BY ALL")
def stage_merge_ablation(f):
    path = _staged(f, "merge-ablation", "pairs.jsonl", ["queries", "scores", "parts", "dense"], "--data-root", "{root}", "--maxsim-parts", "{root}/parts", "--dense-parts", "{root}/dense", "--out", "{out}", "--top-k", "10")
    rows = readers.read_jsonl(f.spark, path, schema.ABLATION)
    return rows.select("split", "query_id", "positive_id", F.array_join(F.zip_with("negative_ids", "negative_sources", lambda d, s: F.concat(d.cast("string"), s)), ",").alias("negatives"))


@query(f"SELECT s.split AS source, md5(coalesce(any_value(q.query), '')) AS query, length(any_value(p.document)) AS positive, " + ", ".join(f"length(max(d.document) FILTER (WHERE slot = {i + 1})) AS negative_{i + 1}" for i in range(fx.NEGATIVES)) + f" FROM sft s JOIN fq q ON q.split = s.split AND q.query_id = s.query_id JOIN fd p ON p.split = s.split AND p.document_id = s.positive_id AND p.document <> '' JOIN fd d ON d.split = s.split AND d.document_id = s.document_id AND d.document <> '' GROUP BY s.split, s.query_id, s.positive_id, s.copy_no HAVING count(*) = {fx.NEGATIVES}")
def stage_prepare_judged(f):
    """The rows of all train_{split}.jsonl, texts by their lengths."""
    pairs = sinks.new_folder(f.spark, "pairs")
    sinks.write_jsonl(f.pairs, pairs, compression="gzip")
    path = _staged(f, "prepare-judged", "train", ["documents", "pool"], "--data-root", "{root}", "--pairs", pairs, "--judge-dir", "{root}/pool", "--out-dir", "{out}", "--budget", str(fx.BUDGET))
    rows = readers.read_training(f.spark, path)
    return rows.select("source", F.md5("query").alias("query"), *[F.length(c).cast("bigint").alias(c) for c in ["positive", *readers.negatives(rows)]])


def _mixture_files(f) -> str:
    return _staged(f, "build-kd-mixture", "lists", ["queries", "documents", "pool"], "--data-root", "{root}", "--pool-dir", "{root}/pool", "--out", "{out}")


@query("SELECT k.query_id, md5(q.query) AS query, k.pos, k.document_id, length(d.document) AS n_chars FROM kd k JOIN fd d ON d.split = k.split AND d.document_id = k.d JOIN fq q ON q.split = k.split AND q.query_id = k.q")
def stage_kd_mixture(f):
    """The three tables of the lists, joined again."""
    t = readers.read_lists(f.spark, _mixture_files(f))
    rows = t["train"].select("query_id", F.posexplode("document_ids").alias("pos", "document_id")).withColumn("pos", F.col("pos") + 1)
    rows = rows.join(t["queries"].withColumnRenamed("text", "query"), "query_id").join(t["documents"], "document_id")
    return rows.select("query_id", F.md5("query").alias("query"), "pos", "document_id", F.length("text").alias("n_chars"))


@query("SELECT k.query_id, k.pos, k.document_id, count(m.t)::DOUBLE AS score FROM kd k LEFT JOIN (SELECT query_id, t, min(pos) AS pos FROM kdword GROUP BY query_id, t) m ON m.query_id = k.query_id AND m.pos = k.pos GROUP BY ALL")
def stage_score_lists(f):
    """Both shards of the lists' files, one run after the other."""
    data, out = _mixture_files(f), sinks.new_folder(f.spark, "scores")
    for shard in ("0", "1"):
        stages.run(f.spark, ["score-lists", "--dataset-dir", data, "--out-dir", out, "--shard", shard, "--n-shards", "2", "--kernel", "siltstone.operators.listwise:newly_covered"])
    return _list_rows(readers.read_parts(f.spark, out, "train", "query_id bigint, document_ids array<bigint>, scores array<float>, split string, shard int"))


# Evaluation


@query("SELECT dataset, query_id, doc_id, round(score, 6) AS score, rank FROM run")
def eval_run(f):
    return metrics.without_self(f.run).select("dataset", "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT split AS dataset, query_id, document_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY round(score, 9) DESC, document_id) AS rank FROM allpairs WHERE document_id <> query_id) WHERE rank <= 100")
def eval_sharded(f):
    """The whole corpus in shards of 200 vectors at most, merged one after the other."""
    corpus = f.vec.select("split", F.col("vec_id").alias("document_id"), "v")
    return metrics.sharded_run(f.queries, corpus, 100, 200).select(F.col("split").alias("dataset"), "query_id", "document_id", F.round("score", 6).alias("score"), "rank")


def _ir_metrics(f):
    run = sinks.staged(metrics.without_self(f.run), "run")
    return metrics.ir_metrics(run, f.qrels, f.run_judgements(run))


@query("SELECT * FROM irm")
def ir_metrics(f):
    return _ir_metrics(f)


@query("SELECT count(*) AS datasets, round(avg(ndcg_10), 6) AS macro_ndcg_10 FROM irm WHERE dataset IN ('c0', 'c1', 'c3')")
def ir_macro(f):
    return metrics.macro(_ir_metrics(f), ["c0", "c1", "c3"])


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
