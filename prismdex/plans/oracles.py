"""SQL for the registered queries, written apart from the DataFrame code that it is compared with."""

from __future__ import annotations

STOPS = "a an the of in on at to for and or with without by from is are was were be this that these those it its showing shows show containing contain contains related about images image photos photo pictures picture videos video clips clip footage brochures brochure documents document pdf pdfs files file"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
EXT = "['.jpg', '.png', '.mp4', '.pdf', '.txt'][CAST(doc_id % 5 + 1 AS INT)]"
MEDIA = "CASE WHEN ext IN ('.jpg', '.png') THEN 'image' WHEN ext = '.mp4' THEN 'video' WHEN ext = '.pdf' THEN 'pdf' END"

DOCS = "docs AS (SELECT *, min(doc_id) OVER (PARTITION BY sha256(text)) AS asset_id, sha256(text) AS sha256 FROM documents)"
FILES = f"""{DOCS}, files AS (
  SELECT '/' || source || '/' || lang || '/' || doc_id || {EXT} AS path, '/' || source || '/' || lang AS folder, doc_id || {EXT} AS name, {EXT} AS ext, n_chars AS size, doc_id * 1000000007 AS mtime_ns, asset_id,
    CASE doc_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'processing' ELSE 'done' END AS state,
    CASE WHEN doc_id % 11 = 0 THEN 'old error' END AS error, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS attempts, doc_id % 13 <> 0 AS present, sha256, doc_id FROM docs)"""
ASSETS = f"""{FILES}, assets AS (
  SELECT asset_id, sha256, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'video' ELSE 'image' END AS type, {EXT} AS ext, n_chars AS size, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status,
    CASE WHEN doc_id % 19 = 0 THEN 'p1' ELSE 'p2' END AS pipeline, doc_id * 3600.0 + 1700000000 AS indexed_ts FROM docs WHERE doc_id = asset_id)"""
ALLOWED = f"{ASSETS}, allowed AS (SELECT asset_id FROM assets a WHERE status = 'ready' AND pipeline = 'p2' AND EXISTS (SELECT 1 FROM files f WHERE f.asset_id = a.asset_id AND f.present))"
CHUNKS = r"""whole AS (SELECT asset_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM docs WHERE doc_id = asset_id),
walk AS (
  SELECT asset_id, t, 0 AS n, 0 AS i, cut AS j FROM (SELECT *, CASE WHEN length(t) <= 900 THEN length(t) WHEN instr(reverse(substr(t, 451, 450)), ' .') > 0 THEN 900 - instr(reverse(substr(t, 451, 450)), ' .') ELSE 900 END AS cut FROM whole)
  UNION ALL
  SELECT asset_id, t, n + 1, i2, CASE WHEN i2 + 900 >= length(t) THEN length(t) WHEN instr(reverse(substr(t, i2 + 451, 450)), ' .') > 0 THEN i2 + 900 - instr(reverse(substr(t, i2 + 451, 450)), ' .') ELSE i2 + 900 END
  FROM (SELECT *, greatest(j - 150, i + 1) AS i2 FROM walk WHERE j < length(t))),
cut AS (SELECT asset_id, n, trim(substr(t, i + 1, j - i)) AS text FROM walk),
chunks AS (SELECT asset_id * 1000 + row_number() OVER (PARTITION BY asset_id ORDER BY n) - 1 AS vid, asset_id, text FROM cut WHERE length(text) >= 20)"""
ASKED = "asked AS (SELECT item_id AS qid, text, embedding AS vector FROM benchmark JOIN embeddings ON item_id = vec_id)"
TERMS = f"""terms AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM asked)
  WHERE length(term) > 1 AND NOT list_contains(string_split('{STOPS}', ' '), term))"""
POSTINGS = """words AS (SELECT vid, asset_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks),
postings AS (SELECT vid, asset_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT vid, asset_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM chunks)"""
BM25 = """df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lengths),
bm AS (
  SELECT qid, asset_id, vid, sum((CASE WHEN n - df + 0.5 > df + 0.5 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS raw
  FROM terms JOIN postings USING (term) JOIN df USING (term) JOIN lengths USING (vid, asset_id), corpus GROUP BY qid, asset_id, vid)"""
SIMS = "sims AS (SELECT q.qid, p.asset_id, p.vid, list_dot_product(CAST(p.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS raw FROM pictures p, asked q)"
PICTURES = "pictures AS (SELECT vec_id AS vid, asset_id, embedding AS vector FROM embeddings JOIN docs ON vec_id = doc_id)"
LABELLED = "pictures AS (SELECT vec_id AS vid, label AS asset_id, embedding AS vector FROM embeddings), asked AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)"


def best(source: str, into: str) -> str:
    return f"{into} AS (SELECT qid, asset_id, vid, raw FROM (SELECT qid, asset_id, vid, round(raw, 9) AS raw FROM {source}) QUALIFY row_number() OVER (PARTITION BY qid, asset_id ORDER BY raw DESC, vid) = 1)"


def hits(source: str, into: str, keep: str) -> str:
    return f"{into} AS (SELECT qid, asset_id, vid, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, vid) - 1 AS rank FROM (SELECT *, max(raw) OVER (PARTITION BY qid) AS first FROM {source}) WHERE {keep} QUALIFY rank < 200)"


def buckets(source: str, key: str, into: str) -> str:
    return f"""{into} AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY {key.split(',')[0]})) AS weight FROM (
  SELECT {key}, CAST('0x' || substr(md5(term), 31, 2) AS INT) AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source}) GROUP BY ALL))"""


def near(floor: float, margin: float) -> str:
    return f"first >= {floor} AND raw >= greatest({floor}, first - {margin})"


SIGNALS = f"""{ALLOWED}, {CHUNKS}, {ASKED}, {PICTURES}, {TERMS}, {POSTINGS}, {BM25}, {SIMS},
{buckets('chunks', 'vid, asset_id', 'cb')}, {buckets('asked', 'qid', 'qb')},
tsims AS (SELECT qid, asset_id, vid, sum(cb.weight * qb.weight) AS raw FROM cb JOIN qb USING (bucket) GROUP BY qid, asset_id, vid),
s1 AS (SELECT * FROM sims SEMI JOIN allowed USING (asset_id)), s2 AS (SELECT * FROM tsims SEMI JOIN allowed USING (asset_id)), s3 AS (SELECT * FROM bm SEMI JOIN allowed USING (asset_id)),
{best('s1', 'b1')}, {best('s2', 'b2')}, {best('s3', 'b3')},
{hits('b1', 'clip', near(0.2, 0.75))}, {hits('b2', 'text', near(0.15, 0.6))}, {hits('b3', 'kw', 'raw >= 0.5 * first')}"""
FUSED = f"""{SIGNALS},
every AS (
  SELECT qid, asset_id, 1 AS s, vid, raw, rank, 1.0 / (61 + rank) AS share, least(1.0, greatest(0.0, (raw - 0.18) / (0.32 - 0.18))) AS conf FROM clip
  UNION ALL SELECT qid, asset_id, 2, vid, raw, rank, 1.0 / (61 + rank), least(1.0, greatest(0.0, (raw - 0.25) / (0.60 - 0.25))) FROM text
  UNION ALL SELECT qid, asset_id, 3, vid, raw, rank, 0.5 / (61 + rank), least(1.0, raw / 12.0) * 0.8 FROM kw),
fused AS (
  SELECT qid, asset_id, max(share) + 0.25 * (sum(share) - max(share)) AS score, max(conf) AS confidence, ['clip', 'text', 'kw'][min_by(s, -share * 1000 + s * 1e-9)] AS best_signal, min(s * 1000 + rank) AS first FROM every GROUP BY qid, asset_id),
typed AS (SELECT f.*, type FROM fused f JOIN assets USING (asset_id)),
wanted AS (SELECT qid, regexp_extract_all(lower(text), '[a-z]+') AS w FROM asked),
boosted AS (
  SELECT * EXCLUDE (score, w), score * CASE WHEN type = 'video' AND list_has_any(w, ['video', 'videos', 'clip', 'clips', 'footage']) OR type = 'image' AND list_has_any(w, ['image', 'images', 'photo', 'photos', 'picture', 'pictures', 'pic', 'pics'])
    OR type = 'pdf' AND list_has_any(w, ['brochure', 'brochures', 'pdf', 'pdfs', 'document', 'documents', 'flyer', 'flyers', 'catalog', 'catalogue', 'report', 'manual']) THEN 1.3 ELSE 1.0 END AS score FROM typed JOIN wanted USING (qid)),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, asset_id) - 1 AS place, score / max(score) OVER (PARTITION BY qid) AS relative FROM boosted)"""
LISTING = f"""{FILES}, listing AS (
  SELECT path, folder, name, ext, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, mtime_ns FROM files WHERE doc_id % 7 <> 0
  UNION ALL SELECT folder || '/new-' || name, folder, 'new-' || name, ext, size, mtime_ns FROM files WHERE doc_id % 3 = 0)"""


def changes(retry: bool, force: bool) -> str:
    return f"""{LISTING}, joined AS (
  SELECT coalesce(f.path, l.path) AS path, f.path AS had, l.path AS seen, coalesce(f.ext, l.ext) AS ext, f.size AS old_size, l.size AS new_size, f.mtime_ns AS old_time, l.mtime_ns AS new_time, f.state AS old_state, f.error AS old_error, f.attempts AS old_attempts, f.present AS old_present
  FROM files f FULL JOIN listing l USING (path)),
marked AS (SELECT *, ({MEDIA}) IS NOT NULL AS supported, old_size IS NOT DISTINCT FROM new_size AND old_time IS NOT DISTINCT FROM new_time AS same FROM joined),
changes AS (SELECT *, CASE WHEN seen IS NULL THEN 'unseen' WHEN had IS NULL AND supported THEN 'new' WHEN had IS NULL THEN 'new_unsupported'
  WHEN supported AND ({force} OR NOT same OR old_state IN ('pending', 'processing', 'unsupported') OR ({retry} AND old_state = 'failed')) THEN CASE WHEN same THEN 'redone' ELSE 'changed' END
  WHEN NOT supported THEN 'unsupported' ELSE 'unchanged' END AS change FROM marked),
next AS (SELECT path, change, CASE WHEN change IN ('new', 'changed', 'redone') THEN 'pending' WHEN change IN ('new_unsupported', 'unsupported') THEN 'unsupported' ELSE old_state END AS state,
  CASE WHEN change IN ('new', 'changed', 'redone') THEN NULL WHEN change IN ('new_unsupported', 'unsupported') THEN 'unsupported file type ''' || ext || '''' ELSE old_error END AS error,
  CAST(CASE WHEN change IN ('new', 'changed', 'redone') THEN 0 ELSE coalesce(old_attempts, 0) END AS INT) AS attempts, CASE WHEN change IN ('unseen', 'unchanged') THEN old_size ELSE new_size END AS size,
  CASE WHEN seen IS NOT NULL THEN true ELSE old_present END AS present FROM changes)"""


def folded(threshold: float) -> str:
    """Frames kept when each is compared with the last one kept, as a recursion over the frames of each label."""
    return f"""WITH RECURSIVE f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
w AS (SELECT label, n, vec_id, v, true AS kept FROM f WHERE n = 1
  UNION ALL SELECT f.label, f.n, f.vec_id, CASE WHEN list_dot_product(f.v, w.v) >= {threshold} THEN w.v ELSE f.v END, list_dot_product(f.v, w.v) < {threshold} FROM w JOIN f ON f.label = w.label AND f.n = w.n + 1)
SELECT label, vec_id FROM w WHERE kept"""


TRANSCRIPT = """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(turn AS DOUBLE) AS t, trim(text) AS x FROM conversations WHERE trim(text) <> ''),
w AS (SELECT conv_id, n, 0 AS ordinal, t AS ref, ' ' || x AS buf FROM s WHERE n = 1
  UNION ALL SELECT s.conv_id, s.n, CASE WHEN length(w.buf) > 500 THEN w.ordinal + 1 ELSE w.ordinal END, CASE WHEN length(w.buf) > 500 THEN s.t ELSE w.ref END, CASE WHEN length(w.buf) > 500 THEN '' ELSE w.buf END || ' ' || s.x
  FROM w JOIN s ON s.conv_id = w.conv_id AND s.n = w.n + 1)
SELECT conv_id, CAST(ordinal AS INT) AS ordinal, round(max_by(ref, n), 1) AS ref, trim(max_by(buf, n)) AS text FROM w GROUP BY conv_id, ordinal"""
