"""The core queries in DuckDB's SQL."""

from __future__ import annotations

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = f"string_split_regex(regexp_replace(text, '(?:{LINE_END})\\z', ''), '{LINE_END}')"
NORMAL = f"regexp_replace(regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/|//[^\\n]*', '', 'g'), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
LENGTHS = f"list_transform({LINES}, lambda x: length(x))"


def draw(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 16))::UHUGEINT::DOUBLE / 18446744073709551616.0)"


def split_of(text: str) -> str:
    d = draw(f"'42:' || {text}")
    return f"CASE WHEN {d} < 0.9 THEN 'train' WHEN {d} < 0.95 THEN 'validation' ELSE 'test' END"


#: The receipts, and each with one value changed, so that every rule has rows that break it.
RECEIPTS = """(SELECT * FROM receipts UNION ALL SELECT * REPLACE (2 AS schema_version, source_id || ' ' AS source_id, upper(commit_sha) AS commit_sha) FROM receipts
  UNION ALL SELECT * REPLACE (substr(tree_sha256, 2) AS tree_sha256, -1 AS file_count, 10737418241 AS total_bytes) FROM receipts
  UNION ALL SELECT * REPLACE (' ' AS git_version, source_uri || '.git' AS source_uri, replace(retrieved_at, 'Z', '+00:00') AS retrieved_at, MAP {'LICENSE': 'none'} AS license_sha256) FROM receipts)"""
RECORDS = "(SELECT DISTINCT * FROM file_records)"
KEY = "lower(trim({}))"
MARKERS = ("@generated", "auto-generated", "automatically generated", "do not edit", "generated by")
HEADER = " OR ".join(f"contains(lower(substr(text, 1, 4096)), '{m}')" for m in MARKERS)
NAME = "regexp_extract(relative_path, '([^/]*)$', 1)"
SUFFIX = f"lower(regexp_extract({NAME}, '.(\\.[^.]+)$', 1))"
GENERATED = f"""list_filter([CASE WHEN {HEADER} THEN 'generated-header' END, CASE WHEN list_max({LENGTHS}) > 2000 THEN 'very-long-line' END,
  CASE WHEN suffix({NAME}, '.generated.ts') OR suffix({NAME}, '.gen.ts') OR suffix({NAME}, '.d.ts') THEN 'generated-filename' END,
  CASE WHEN len({LINES}) > 20 AND len(list_distinct({LINES})) / len({LINES}) < 0.25 THEN 'high-repetition' END], lambda x: x IS NOT NULL)"""


def quality(limit: int) -> str:
    return f"""list_filter([CASE WHEN contains(text, chr(0)) THEN 'null-byte' END, CASE WHEN regexp_matches(text, '[\\x{{202a}}-\\x{{202e}}]') THEN 'unicode-control' END,
  CASE WHEN strlen(text) > {limit} THEN 'oversized' END, CASE WHEN list_max({LENGTHS}) > 5000 THEN 'minified' END], lambda x: x IS NOT NULL)"""


def license_case() -> str:
    from lodestrand.operators.governance import MARKERS as marks

    low = "lower(substr(text, 1, 100001))"
    tag = f"regexp_extract({low}, 'spdx-license-identifier:\\s*([a-z0-9.+-]+)', 1)"
    cases = " ".join("WHEN " + " AND ".join(f"contains({low}, '{m}')" for m in ms) + f" THEN '{n}'" for n, ms in marks)
    return f"CASE WHEN {tag} <> '' THEN {tag} {cases} ELSE 'NOASSERTION' END"


LATEST = """SELECT source_id, source_uri, commit_sha, approval_id, status, license_spdx FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_uri, commit_sha ORDER BY coalesce(approved_at, '') DESC, approval_id DESC) AS r
  FROM (SELECT DISTINCT ON (approval_id) * FROM approvals)) WHERE r = 1"""
BARE = "regexp_replace(source_uri, '[?#].*$', '')"
REST = f"regexp_replace({BARE}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
SCHEME = f"lower(regexp_extract({BARE}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
HOSTPORT = f"regexp_replace(regexp_extract({REST}, '^//([^/]*)', 1), '^.*@', '')"
SAFE = f"""CASE WHEN {SCHEME} = '' THEN {BARE} WHEN regexp_extract({REST}, '^//([^/]*)', 1) = '' THEN {SCHEME} || ':' || {REST}
  ELSE {SCHEME} || '://' || lower(regexp_replace({HOSTPORT}, ':[^:\\]]*$', '')) || CASE WHEN regexp_extract({HOSTPORT}, ':(\\d{{1,5}})$', 1) <> '' AND try_cast(regexp_extract({HOSTPORT}, ':(\\d{{1,5}})$', 1) AS INT) <= 65535
    THEN ':' || regexp_extract({HOSTPORT}, ':(\\d{{1,5}})$', 1) ELSE '' END || regexp_replace({REST}, '^//[^/]*', '') END"""


def oracle_sql() -> dict[str, str]:
    documents = "(SELECT * FROM documents WHERE text IS NOT NULL)"
    plain = {
        "corpus_overview": f"""WITH rows AS (SELECT doc_id, source, sha256({NORMAL}) AS cluster FROM {documents} WHERE len({quality(1_000_000)}) + len({GENERATED}) = 0),
          kept AS (SELECT cluster, arg_min_null(source, doc_id) AS source FROM rows GROUP BY cluster)
          SELECT {split_of('cluster')} AS split, coalesce(source, 'none') AS source, count(*) AS documents FROM kept GROUP BY 1, 2""",
        "quality_metrics": f"""SELECT doc_id, strlen(text)::BIGINT AS size_bytes, len({LINES})::BIGINT AS line_count, list_sum({LENGTHS})::DOUBLE / len({LINES}) AS mean_line_length, list_max({LENGTHS})::BIGINT AS max_line_length,
          (length(text) - length(regexp_replace(text, '//[^\\n]*|/\\*[\\s\\S]*?\\*/', '', 'g')))::DOUBLE / greatest(length(text), 1) AS comment_ratio,
          (length(text) - length(regexp_replace(text, '{SPACE}', '', 'g')))::DOUBLE / greatest(length(text), 1) AS whitespace_ratio,
          len(list_distinct(regexp_extract_all(text, '[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*')))::DOUBLE / greatest(len(regexp_extract_all(text, '[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*')), 1) AS identifier_diversity,
          1 - len(list_distinct({LINES}))::DOUBLE / len({LINES}) AS repetition_ratio FROM {documents}""",
        "quality_reasons": f"""SELECT doc_id, array_to_string({quality(100_000)}, ',') AS reasons, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * len({quality(100_000)}) - 0.3::DOUBLE * (1 - len(list_distinct({LINES}))::DOUBLE / len({LINES}))) AS score FROM {documents}""",
        "generated_status": f"SELECT doc_id, array_to_string(list_sort({GENERATED}), ',') AS reasons FROM {documents}",
        "path_filters": f"""SELECT doc_id, CASE WHEN list_has_any(string_split(relative_path, '/'), ['node_modules', 'dist', 'build', '.next', 'coverage', '.cache', '.git', 'vendor']) THEN 'excluded-path'
            WHEN {SUFFIX} IN ('.map', '.lock', '.pem', '.key') OR suffix({NAME}, '.lock') THEN 'excluded-file-type' ELSE '' END AS rejection,
          CASE WHEN suffix(relative_path, '.d.ts') THEN 'declaration' WHEN suffix(relative_path, '.tsx') THEN 'code' WHEN contains(lower(relative_path), '/test') OR prefix(lower(relative_path), 'test') THEN 'test'
            WHEN suffix(relative_path, 'package.json') OR suffix(relative_path, 'tsconfig.json') THEN 'metadata' WHEN suffix(relative_path, '.ts') THEN 'code' ELSE 'metadata' END AS source_type,
          CASE WHEN {NAME} IN ('package.json', 'tsconfig.json') THEN 'metadata' WHEN {SUFFIX} NOT IN ('.ts', '.tsx') THEN 'unsupported-extension' WHEN suffix({NAME}, '.min.ts') OR suffix({NAME}, '.bundle.ts') THEN 'bundled-filename'
            WHEN NOT regexp_matches(text, '\\b(interface|type|class|function|const|let|enum|namespace|import|export|declare)\\b|=>|<[A-Z][\\p{{L}}\\p{{N}}_.]*') THEN 'no-typescript-syntax' ELSE 'typescript' END AS language FROM {documents}""",
        "approved_scope": """SELECT doc_id, (regexp_matches(relative_path, '(?s)^src/.*$') OR regexp_matches(relative_path, '(?s)^packages/.*\\.ts$')) AND NOT (regexp_matches(relative_path, '(?s)^.*\\.d\\.ts$') OR regexp_matches(relative_path, '(?s)^.*/__snapshots__/.*$')) AS in_scope FROM documents""",
        "harness_filter": f"""SELECT doc_id, array_to_string(list_sort(list_filter([
            CASE WHEN contains('/' || lower(relative_path) || '/', '/fourslash/') OR prefix(lower(relative_path), 'fourslash/') THEN 'test-harness-fourslash-path' END,
            CASE WHEN regexp_matches(text, '(?im)^\\s*//\\s*@filename\\s*:') THEN 'test-harness-filename-directive' END,
            CASE WHEN regexp_matches(text, '(?i)<reference\\s+path\\s*=\\s*["\\x27](?:\\.\\.?/)*fourslash\\.ts["\\x27]') THEN 'test-harness-fourslash-reference' END,
            CASE WHEN (contains('/' || lower(relative_path), '/test') OR prefix(lower(relative_path), 'test/')) AND regexp_matches(text, '\\bverify\\.[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*\\s*\\(') THEN 'test-harness-verify-api' END,
            CASE WHEN (contains('/' || lower(relative_path), '/test') OR prefix(lower(relative_path), 'test/')) AND regexp_matches(text, '\\b(?:goTo|edit|formatCode|baseline)\\.[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*\\s*\\(') THEN 'test-harness-editor-api' END
          ], lambda x: x IS NOT NULL)), ',') AS reasons, regexp_matches(text, '(?m)^[ \\t]*// @(?:Filename|BaselineFile):') AS in_stream FROM {documents}""",
        "license_detect": f"SELECT doc_id, {license_case()} AS spdx FROM {documents}",
        "uri_sanitize": f"SELECT source_uri, {SAFE} AS safe_uri FROM (SELECT DISTINCT source_uri FROM file_records WHERE source_uri IS NOT NULL)",
        "record_ids": f"""SELECT doc_id, sha256(repository_id || chr(0) || relative_path || chr(0) || sha256(text)) AS made_id, (('0x' || substr(sha256(record_id), 1, 16))::UHUGEINT % 8)::INT AS owner,
          {draw("'objective:42:' || record_id")} < 0.5 AS fim, {split_of('record_id')} AS hashed_split FROM {documents} WHERE repository_id IS NOT NULL""",
        "normalized_hash": f"SELECT doc_id, sha256({NORMAL}) AS normalized_sha256 FROM {documents}",
        "exact_dedup": f"SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY h) AS is_duplicate FROM (SELECT doc_id, sha256({NORMAL}) AS h FROM {documents})",
        "shingle_stats": f"""WITH t AS (SELECT doc_id, regexp_extract_all({NORMAL}, '[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*|[^\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') AS t FROM {documents}),
          s AS (SELECT doc_id, substr(sha256(array_to_string(t[i:i + 4], chr(31))), 1, 16) AS h FROM (SELECT doc_id, t, unnest(range(1, greatest(2, len(t) - 3))) AS i FROM t))
          SELECT doc_id, count(DISTINCT h)::BIGINT AS shingles, min(h) AS smallest FROM s GROUP BY doc_id""",
        "near_dup_pairs": f"""WITH c AS (SELECT min(doc_id) AS id, n FROM (SELECT doc_id, {NORMAL} AS n FROM {documents}) GROUP BY n),
          t AS (SELECT id, regexp_extract_all(n, '[A-Za-z_$][\\p{{L}}\\p{{N}}_$]*|[^\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') AS t FROM c),
          s AS (SELECT DISTINCT id, md5(array_to_string(t[i:i + 4], chr(31))) AS h FROM (SELECT id, t, unnest(range(1, greatest(2, len(t) - 3))) AS i FROM t)),
          n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2)
          SELECT a, b, common::BIGINT AS common FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common::DOUBLE / (x.n + y.n - common) >= 0.85""",
        "cluster_split": f"""WITH r AS (SELECT DISTINCT record_id, lower(trim(dedup_cluster)) AS c, included FROM file_records WHERE dedup_cluster IS NOT NULL AND included IS NOT NULL)
          SELECT CASE WHEN included THEN {split_of('c')} ELSE 'excluded' END AS split, count(*) AS records FROM r GROUP BY 1""",
        "build_summary": f"SELECT count(*) AS records, count_if(included) AS included, count_if(NOT included) AS rejected, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT source_uri) AS selected_sources FROM {RECORDS}",
        "group_counts": f"""SELECT facet, value, count(*) AS records FROM (SELECT 'license' AS facet, license_spdx AS value FROM {RECORDS} UNION ALL SELECT 'source_type', source_type FROM {RECORDS}
          UNION ALL SELECT 'secret_status', secret_scan_status FROM {RECORDS} UNION ALL SELECT 'split', split FROM {RECORDS} WHERE included) GROUP BY 1, 2""",
        "reason_counts": f"SELECT reason, count(*) AS records FROM (SELECT unnest(exclusion_reasons) AS reason FROM {RECORDS}) GROUP BY 1",
        "cluster_stats": f"SELECT count(*) AS clusters, count_if(n > 1) AS multi_record_clusters, max(n) AS largest_cluster FROM (SELECT count(*) AS n FROM {RECORDS} WHERE dedup_cluster IS NOT NULL GROUP BY dedup_cluster)",
        "leakage": f"""SELECT key, count_if(n > 1)::BIGINT AS overlaps FROM (SELECT key, value, count(DISTINCT split) AS n FROM (SELECT 'dedup_cluster' AS key, dedup_cluster AS value, split FROM {RECORDS} WHERE included
          UNION ALL SELECT 'normalized_sha256', normalized_sha256, split FROM {RECORDS} WHERE included UNION ALL SELECT 'repository_id', repository_id, split FROM {RECORDS} WHERE included) GROUP BY 1, 2) GROUP BY 1""",
        "repositories_by_split": f"SELECT split, count(*) AS repositories FROM (SELECT repository_id, CASE WHEN min(split) = max(split) THEN min(split) ELSE 'mixed' END AS split FROM {RECORDS} WHERE included GROUP BY 1) GROUP BY 1",
        "latest_approval": f"SELECT source_id, source_uri, commit_sha, approval_id, status FROM ({LATEST})",
        "approval_coverage": f"""WITH used AS (SELECT DISTINCT {SAFE} AS source_uri, commit_sha FROM {RECORDS} WHERE included AND source_uri IS NOT NULL AND commit_sha IS NOT NULL),
          last AS (SELECT source_uri, commit_sha, status FROM (SELECT *, row_number() OVER (PARTITION BY source_uri, commit_sha ORDER BY coalesce(approved_at, '') DESC, approval_id DESC NULLS LAST) AS r FROM approvals) WHERE r = 1)
          SELECT used.source_uri, used.commit_sha, coalesce(status, 'missing') AS state FROM used LEFT JOIN last USING (source_uri, commit_sha)""",
        "approval_status": "SELECT count_if(status = 'approved') AS approved, count_if(status = 'review') AS review, count_if(status = 'rejected') AS rejected, count_if(status = 'removed') AS removed, count(*) AS records FROM approvals",
        "duplicate_decisions": "SELECT approval_id, count(*) AS rows FROM approvals WHERE approval_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "license_disagreements": f"""WITH a AS (SELECT DISTINCT source_uri, commit_sha, license_spdx AS approved_spdx FROM ({LATEST}) WHERE status = 'approved'), f AS (SELECT DISTINCT {SAFE} AS source_uri, commit_sha, license_spdx AS detected_spdx FROM file_records WHERE source_uri IS NOT NULL AND commit_sha IS NOT NULL AND license_spdx IS NOT NULL)
          SELECT source_uri, commit_sha, approved_spdx, detected_spdx FROM a JOIN f USING (source_uri, commit_sha) WHERE approved_spdx <> detected_spdx""",
        "tree_totals": """SELECT repository_id, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes FROM (SELECT DISTINCT lower(trim(repository_id)) AS repository_id, relative_path, coalesce(content_sha256, '') AS c, size_bytes FROM file_records WHERE repository_id IS NOT NULL AND relative_path IS NOT NULL) GROUP BY 1""",
        "exact_contamination": f"SELECT doc_id FROM {documents} WHERE lower(trim(split)) IN ('validation', 'test') AND text IN (SELECT text FROM {documents} WHERE lower(trim(split)) = 'train')",
        "nearest_lengths": f"""SELECT task_id, candidate_sha256, candidate_length, rank::INT AS rank FROM (SELECT id AS task_id, sha256(text) AS candidate_sha256, length(text)::INT AS candidate_length, row_number() OVER (PARTITION BY id ORDER BY abs(length(text) - length(middle)), sha256(text)) AS rank
          FROM fim_tasks, (SELECT DISTINCT text FROM {documents})) WHERE rank <= 16""",
        "repetition_rate": f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {documents})
          SELECT doc_id, CASE WHEN len(w) < 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(31)))))::DOUBLE / (len(w) - 2) END AS repetition FROM w""",
        "causal_windows": """WITH c AS (SELECT id, list_transform(string_split(prompt, ''), lambda x: unicode(x)) AS ids FROM completion_tasks),
          s AS (SELECT id, ids, (unnest(range(0, len(ids) - 1, 127)))::INT AS token_start FROM c WHERE len(ids) >= 2)
          SELECT id, (token_start // 127)::INT AS window_no, token_start, array_to_string(list_concat(ids[token_start + 1:token_start + 128], list_transform(range(0, 128 - len(ids[token_start + 1:token_start + 128])), lambda i: 0)), ',') AS input_ids,
            len(list_filter(ids[token_start + 1:token_start + 128], lambda x: x <> 0))::INT AS loss_positions FROM s""",
        "packed_blocks": f"""WITH d AS (SELECT doc_id::VARCHAR AS record_id, lower(trim(repository_id)) AS repository_id, CASE WHEN text = '' THEN 2 ELSE length(text) + 1 END AS n FROM {documents} WHERE repository_id IS NOT NULL),
          o AS (SELECT *, sum(n) OVER (PARTITION BY repository_id ORDER BY record_id) - n AS o FROM d),
          b AS (SELECT repository_id, record_id, o, n, unnest(range((o // 4096)::BIGINT, ((o + n - 1) // 4096)::BIGINT + 1))::INT AS block FROM o)
          SELECT repository_id, block, sum(least(o + n, (block + 1) * 4096) - greatest(o, block * 4096))::INT AS n_tokens, string_agg(record_id, ',' ORDER BY o) AS record_ids FROM b GROUP BY 1, 2 HAVING n_tokens > 1""",
        "document_shards": f"""WITH r AS (SELECT record_id, (row_number() OVER (ORDER BY record_id) - 1) // 100 AS shard FROM (SELECT DISTINCT record_id FROM file_records WHERE included))
          SELECT shard, count(*) AS records, sha256(string_agg(record_id, chr(10) ORDER BY record_id)) AS sha256 FROM r GROUP BY 1""",
        "budget_prefix": """WITH m AS (SELECT run_name, step, max(loss_tokens) AS loss_tokens FROM training_metrics WHERE loss_tokens IS NOT NULL GROUP BY 1, 2)
          SELECT run_name, step, loss_tokens FROM (SELECT *, sum(loss_tokens) OVER (PARTITION BY run_name ORDER BY step ROWS UNBOUNDED PRECEDING) AS s FROM m) WHERE s - loss_tokens < 50000""",
        "interval_boundaries": """WITH m AS (SELECT run_name, step, max(tokens_processed) AS tokens_processed FROM training_metrics WHERE tokens_processed IS NOT NULL GROUP BY 1, 2)
          SELECT * FROM (SELECT run_name, step, tokens_processed, tokens_processed // 25000 - coalesce(lag(tokens_processed) OVER (PARTITION BY run_name ORDER BY step), 0) // 25000 AS crossed FROM m) WHERE crossed > 0""",
        "weighted_loss": "SELECT run_name, sum(loss_tokens)::BIGINT AS loss_tokens, round(sum(loss * loss_tokens) / sum(loss_tokens), 6) AS mean_loss FROM (SELECT DISTINCT * FROM training_metrics) WHERE loss IS NOT NULL AND loss_tokens > 0 GROUP BY 1",
        "padding": """SELECT run_name, sum(batch_tokens)::BIGINT AS batch_tokens, sum(padded_tokens)::BIGINT AS padded_tokens, sum(padding_tokens)::BIGINT AS padding_tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_name, step ORDER BY tokens_processed DESC) AS r FROM training_metrics WHERE tokens_processed IS NOT NULL) WHERE r = 1 GROUP BY 1""",
        "cosine_schedule": "SELECT DISTINCT step, round(CASE WHEN step < 10 THEN (step + 1) / 10.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1.0::DOUBLE + cos(pi() * least((step - 10) / 190.0::DOUBLE, 1.0::DOUBLE))) END, 9) AS factor FROM training_metrics WHERE step IS NOT NULL",
        "model_audit": """WITH s AS (SELECT capacity, capacity // 4 AS h FROM pack_limits), p AS (SELECT capacity, h, 50257 * h AS token_embeddings, 12 * (h * h * 2 + h * (2 * (h // 8)) * 2) AS attention_projections, 12 * h * (h * 3) * 3 AS feed_forward, 12 * h * 2 + h AS normalization, 0::BIGINT AS output_projection FROM s),
          t AS (SELECT *, token_embeddings + attention_projections + feed_forward + normalization AS total, capacity * h * 12 * 4 * 4 AS a FROM p)
          SELECT capacity, token_embeddings, attention_projections, feed_forward, normalization, output_projection, total, total * 4 AS weights_bytes, total * 4 AS gradients_bytes, total * 8 AS optimizer_states_bytes, a AS activation_reserve_bytes, total * 16 + a AS total_estimate_bytes FROM t""",
        "repository_pack": f"""SELECT lower(trim(repository_id)) AS repository_id, relative_path, sha256('<file path="' || replace(replace(replace(regexp_replace(relative_path, '^/+', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '">' || chr(10) || text || chr(10) || '</file>') AS part_sha256 FROM {documents} WHERE repository_id IS NOT NULL""",
        "evaluation_rates": """WITH t AS (SELECT id, string_split_regex(middle, '\\s+') AS w, string_split_regex(coalesce(prefix, ''), '\\s+') AS g FROM fim_tasks WHERE middle IS NOT NULL)
          SELECT count(*) AS n, avg((w = g)::INT::DOUBLE) AS exact_match, round(avg(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(range(1, len(w) + 1), lambda i: i <= len(g) AND w[i] = g[i]))::DOUBLE / len(w) END), 9) AS token_accuracy FROM t""",
        "family_split": f"""WITH RECURSIVE rows AS (SELECT {KEY.format('repository_id')} AS r, {KEY.format('dedup_cluster')} AS c FROM {RECORDS} WHERE included AND repository_id IS NOT NULL AND dedup_cluster IS NOT NULL),
          ties AS (SELECT DISTINCT r, c FROM rows), edges AS (SELECT DISTINCT a.r AS u, b.r AS v FROM ties a JOIN ties b ON a.c = b.c), reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
          fam AS (SELECT u AS repository_id, min(v) AS family FROM reach GROUP BY u), w AS (SELECT family, count(*) AS weight FROM rows JOIN fam ON rows.r = fam.repository_id GROUP BY family),
          k AS (SELECT *, row_number() OVER (ORDER BY weight DESC, family) AS rank, count(*) OVER () AS n, {split_of("'repository-family:' || family")} AS hashed FROM w),
          v AS (SELECT *, CASE WHEN NOT bool_or(hashed = 'validation') OVER () AND rank = n THEN 'validation' ELSE hashed END AS s FROM k),
          t AS (SELECT *, bool_or(s = 'test') OVER () AS has_t, max(CASE WHEN rank = n - 1 THEN s END) OVER () AS before_last FROM v)
          SELECT repository_id, family, weight::BIGINT AS weight, CASE WHEN n <= 3 THEN (CASE rank WHEN 1 THEN 'train' WHEN 2 THEN 'validation' ELSE 'test' END) WHEN NOT has_t AND rank = CASE WHEN before_last = 'train' THEN n - 1 ELSE n END THEN 'test' ELSE s END AS split FROM fam JOIN t USING (family)""",
        "approval_violations": f"""SELECT violation, count(*) AS records FROM (SELECT unnest(list_filter([
            CASE WHEN NOT coalesce(regexp_matches(source_id, '^[A-Za-z0-9][A-Za-z0-9_.-]{{0,127}}$'), false) THEN 'source-id' END, CASE WHEN NOT coalesce({SAFE} = source_uri, false) THEN 'unsafe-uri' END,
            CASE WHEN NOT coalesce(regexp_matches(source_uri, '^[A-Za-z][A-Za-z0-9+.-]*:'), false) THEN 'no-scheme' END, CASE WHEN NOT coalesce(commit_sha = 'fixture' OR regexp_matches(commit_sha, '^[0-9a-f]{{40}}$'), false) THEN 'commit' END,
            CASE WHEN NOT coalesce(license_spdx IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', '0BSD', 'CC0-1.0', 'Unlicense'), false) THEN 'license' END,
            CASE WHEN NOT coalesce(status IN ('approved', 'review', 'rejected', 'removed'), false) THEN 'status' END,
            CASE WHEN status = 'approved' AND (coalesce(trim(approved_by), '') = '' OR coalesce(trim(approved_at), '') = '' OR coalesce(len(scope), 0) = 0) THEN 'incomplete-approval' END,
            CASE WHEN len(list_filter(scope, lambda s: s <> 'typescript-source' AND (NOT regexp_matches(s, '^(?:include|exclude):[^\\x00\\\\]+$') OR regexp_matches(s, '^\\w+:/') OR regexp_matches(s, '(?:^\\w+:|/)\\.\\.(?:/|$)')))) > 0 THEN 'scope' END,
            CASE WHEN NOT coalesce(approval_id = sha256(source_id || chr(0) || source_uri || chr(0) || commit_sha || chr(0) || license_spdx || chr(0) || status || chr(0) || approved_at), false) THEN 'approval-id' END,
            CASE WHEN supersedes = approval_id THEN 'supersedes-itself' END], lambda x: x IS NOT NULL)) AS violation FROM approvals) GROUP BY 1""",
        "receipt_violations": f"""SELECT violation, count(*) AS records FROM (SELECT unnest(list_filter([
            CASE WHEN coalesce(schema_version <> 1, true) THEN 'schema-version' END, CASE WHEN NOT coalesce(regexp_full_match(source_id, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,127}}'), false) THEN 'source-id' END, CASE WHEN NOT coalesce(regexp_full_match(commit_sha, '[0-9a-f]{{40}}'), false) THEN 'commit' END,
            CASE WHEN NOT coalesce(regexp_full_match(tree_sha256, '[0-9a-f]{{64}}'), false) THEN 'tree' END, CASE WHEN NOT coalesce(file_count BETWEEN 0 AND 1000000, false) THEN 'file-count' END, CASE WHEN NOT coalesce(total_bytes BETWEEN 0 AND 10737418240, false) THEN 'total-bytes' END,
            CASE WHEN coalesce(trim(git_version), '') = '' THEN 'git-version' END,
            CASE WHEN NOT coalesce(regexp_full_match(source_uri, 'https://github\\.com/[A-Za-z0-9][A-Za-z0-9-]{{0,38}}/[A-Za-z0-9][A-Za-z0-9._-]{{0,99}}') AND NOT suffix(source_uri, '.git'), false) THEN 'source-uri' END,
            CASE WHEN NOT coalesce(regexp_full_match(retrieved_at, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d{{1,6}})?Z') AND try_cast(retrieved_at AS TIMESTAMPTZ) IS NOT NULL, false) THEN 'retrieved-at' END,
            CASE WHEN license_sha256 IS NULL OR len(list_filter(map_values(license_sha256), lambda v: v IS NULL OR NOT regexp_full_match(v, '[0-9a-f]{{64}}'))) > 0 THEN 'license-digest' END], lambda x: x IS NOT NULL)) AS violation FROM {RECEIPTS}) GROUP BY 1""",
    }
    return plain | corpus_sql(plain, documents) | clusters_sql(documents) | small_sql(documents)


def secret_categories() -> str:
    from lodestrand.functions import secrets

    quote = lambda p: "'" + p.replace("'", "''") + "'"
    forms = ", ".join(f"CASE WHEN regexp_matches(text, {quote(p)}) THEN '{name}' END" for p, name in secrets.FORMS)
    named = f"CASE WHEN len(list_filter(regexp_extract_all(text, {quote(secrets.NAMED)}, 1), lambda v: NOT regexp_matches(v, {quote(secrets.HARMLESS)}) AND len(list_distinct(string_split(v, ''))) >= 6)) > 0 THEN 'named-literal' END"
    return f"list_sort(list_distinct(list_filter([{forms}, {named}], lambda x: x IS NOT NULL)))"


def license_by_repository(files: str) -> str:
    return f"""(SELECT repository_id, CASE WHEN n = 1 THEN names[1] WHEN n > 1 THEN 'CONFLICTING' ELSE 'NOASSERTION' END AS spdx,
      CASE WHEN n = 1 AND names[1] IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', '0BSD', 'CC0-1.0', 'Unlicense') THEN 'accepted' ELSE 'review' END AS status, coalesce(evidence, 'no-license-file') AS evidence
      FROM (SELECT repository_id, len(names) AS n, names, evidence FROM (SELECT DISTINCT repository_id FROM {files}) LEFT JOIN (SELECT repository_id, list(DISTINCT spdx) AS names, array_to_string(list_sort(list(DISTINCT relative_path)), ',') AS evidence
        FROM (SELECT repository_id, relative_path, {license_case()} AS spdx FROM {files} WHERE regexp_matches(lower(relative_path), '^(?:license|copying)[^/]*$')) GROUP BY 1) USING (repository_id)))"""


def corpus_sql(plain: dict[str, str], documents: str) -> dict[str, str]:
    """The records of the build, put together from the queries of its parts."""
    part = lambda name: f"({plain[name].replace(documents, 'f')})"
    licences = license_by_repository("f")
    return {"corpus_records": f"""WITH a AS (SELECT doc_id, lower(trim(repository_id)) AS repository_id, relative_path, coalesce(text, '') AS whole FROM documents WHERE repository_id IS NOT NULL AND relative_path IS NOT NULL),
      b AS (SELECT * FROM a UNION ALL SELECT -row_number() OVER (ORDER BY repository_id), repository_id, 'LICENSE', CASE WHEN substr(sha256(repository_id), 1, 1) > '2' THEN 'Permission is hereby granted, free of charge, to any person' ELSE 'All rights reserved.' END FROM (SELECT DISTINCT repository_id FROM a)),
      f AS (SELECT *, CASE WHEN strlen(whole) > 100000 THEN '' ELSE whole END AS text FROM b),
      h AS (SELECT doc_id, repository_id, sha256(CASE WHEN strlen(whole) > 100000 THEN encode(whole)[1:100000] ELSE encode(whole) END) AS content_sha256, strlen(whole)::BIGINT AS size_bytes, strlen(whole) > 100000 AS oversized FROM f),
      s AS (SELECT doc_id, {secret_categories()} AS found, {quality(1_000_000)} AS quality, len({LINES}) AS n_lines, len(list_distinct({LINES}))::DOUBLE AS n_distinct FROM f),
      r AS (SELECT *, list_sort(list_distinct(list_concat(list_filter([CASE WHEN p.rejection <> '' THEN p.rejection END, CASE WHEN regexp_matches(f.relative_path, '/__snapshots__/') THEN 'outside-approved-scope' END, CASE WHEN oversized THEN 'oversized' END,
          CASE WHEN len(list_filter(string_split(f.relative_path, '/'), lambda x: x NOT IN ('', '.'))) > 12 THEN 'path-depth-limit' END, CASE WHEN p.language NOT IN ('typescript', 'metadata') THEN p.language END,
          CASE WHEN l.status <> 'accepted' THEN 'license:' || l.status END], lambda x: x IS NOT NULL), list_filter(string_split(g.reasons || ',' || w.reasons, ','), lambda x: x <> ''), list_transform(s.found, lambda x: 'secret:' || x), s.quality))) AS why
        FROM f JOIN h USING (doc_id) JOIN s USING (doc_id) JOIN {part("path_filters")} p USING (doc_id) JOIN {part("generated_status")} g USING (doc_id) JOIN {part("harness_filter")} w USING (doc_id) JOIN {part("normalized_hash")} n USING (doc_id) JOIN {licences} l ON l.repository_id = f.repository_id)
      SELECT DISTINCT sha256(repository_id || chr(0) || relative_path || chr(0) || content_sha256) AS record_id, spdx AS license_spdx, status AS license_status,
        CASE WHEN {SUFFIX} IN ('.ts', '.tsx') THEN 'typescript' WHEN {NAME} IN ('package.json', 'tsconfig.json') THEN 'metadata' ELSE 'other' END AS language, source_type, size_bytes, CASE WHEN text = '' THEN 0 ELSE n_lines END::INT AS line_count,
        CASE WHEN oversized THEN 'prefix' ELSE 'full' END AS content_hash_scope, normalized_sha256, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * len(quality) - 0.3::DOUBLE * (1 - n_distinct / n_lines)), 6) AS quality_score,
        CASE WHEN len(found) > 0 THEN 'rejected' ELSE 'clean' END AS secret_scan_status, CASE WHEN reasons <> '' THEN 'generated' ELSE 'human' END AS generated_status, len(why) = 0 AS included, array_to_string(why, ',') AS exclusion_reasons FROM r"""}


def clusters_sql(documents: str) -> dict[str, str]:
    """The scan in order of the records, one step for each: which earlier ones lead is a list that grows."""
    token = "[A-Za-z_$][\\p{L}\\p{N}_$]*|[^\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    return {"leader_clusters": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rid)::INT AS rn, * FROM (SELECT sha256(concat_ws(':', record_id, doc_id)) AS rid, {NORMAL} AS n, coalesce(split, '') <> 'excluded' AS included FROM {documents})),
      c AS (SELECT n, min(rn) AS id, regexp_extract_all(n, '{token}') AS t FROM d GROUP BY n),
      s AS (SELECT DISTINCT id, hash(array_to_string(t[i:i + 4], chr(31))) AS h FROM (SELECT id, t, unnest(range(1, greatest(2, len(t) - 3))) AS i FROM c)),
      z AS (SELECT id, count(*) AS k FROM s GROUP BY id),
      p AS (SELECT a.id AS x, b.id AS y FROM s a JOIN s b ON a.h = b.h AND a.id <> b.id JOIN z u ON u.id = a.id JOIN z v ON v.id = b.id WHERE least(u.k, v.k) >= 0.85 * greatest(u.k, v.k) GROUP BY a.id, b.id, u.k, v.k HAVING count(*)::DOUBLE / (u.k + v.k - count(*)) >= 0.85),
      e AS MATERIALIZED (SELECT d.*, c.id FROM d JOIN c USING (n)),
      eq AS (SELECT e.rn, list(o.rn) AS equal FROM e JOIN e o ON o.id = e.id AND o.rn < e.rn GROUP BY 1),
      nr AS (SELECT e.rn, list(o.rn) AS near FROM e JOIN p ON p.x = e.id JOIN e o ON o.id = p.y AND o.rn < e.rn WHERE o.included AND e.included GROUP BY 1),
      q AS MATERIALIZED (SELECT e.rn, coalesce(equal, []) AS equal, coalesce(near, []) AS near FROM e LEFT JOIN eq USING (rn) LEFT JOIN nr USING (rn)),
      step AS (SELECT 0 AS rn, []::INT[] AS leaders, 0 AS chosen
        UNION ALL SELECT rn, CASE WHEN chosen = rn THEN list_append(leaders, rn) ELSE leaders END, chosen FROM (SELECT q.rn, step.leaders, coalesce(list_min(list_intersect(q.equal, step.leaders)), list_min(list_intersect(q.near, step.leaders)), q.rn) AS chosen FROM step JOIN q ON q.rn = step.rn + 1))
      SELECT d.rid AS record_id, l.rid AS dedup_cluster FROM step JOIN d USING (rn) JOIN d l ON l.rn = step.chosen"""}


def small_sql(documents: str) -> dict[str, str]:
    github = "'https://github\\.com/[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9][A-Za-z0-9._-]{0,99}'"
    addressed = lambda c: f"(regexp_full_match({c}, {github}) AND NOT suffix({c}, '.git'))"
    fim = f"({draw("'objective:42:' || record_id")} < 0.5)"
    licensed = f"(SELECT lower(trim(repository_id)) AS repository_id, CASE WHEN regexp_matches(relative_path, '(?i)[.]md$') THEN 'LICENSE-' || doc_id ELSE relative_path END AS relative_path, text FROM {documents} WHERE repository_id IS NOT NULL AND relative_path IS NOT NULL)"
    parts = "list_filter(string_split(relative_path, '/'), lambda x: x NOT IN ('', '.'))"
    return {
        "secret_findings": f"SELECT doc_id, array_to_string(c, ',') AS categories, len(c) > 0 AS contains_secret FROM (SELECT doc_id, {secret_categories()} AS c FROM {documents})",
        "repository_licenses": f"SELECT * FROM {license_by_repository(licensed)}",
        "canonical_addresses": f"SELECT DISTINCT source_uri, {addressed('source_uri')} AS canonical, {addressed("regexp_replace(source_uri, '[.]git$', '')")} AS canonical_without_git FROM file_records WHERE source_uri IS NOT NULL",
        "tree_entries": f"""WITH p AS (SELECT DISTINCT relative_path FROM file_records), a AS (SELECT relative_path FROM p UNION ALL SELECT '/' || relative_path FROM p UNION ALL SELECT 'a/../' || relative_path FROM p)
          SELECT relative_path, array_to_string(list_filter([CASE WHEN relative_path IS NULL OR relative_path = '' OR starts_with(relative_path, '/') OR contains(relative_path, chr(92)) OR contains(relative_path, chr(0)) OR list_contains({parts}, '..') OR len({parts}) > 4 THEN 'unsafe-path' END,
            CASE WHEN starts_with(relative_path, 'test') THEN 'mode' END], lambda x: x IS NOT NULL), ',') AS violations FROM a""",
        "cursor_checks": """SELECT DISTINCT run_name, step, array_to_string(list_filter([CASE WHEN step % 5 - 1 < 0 THEN 'epoch' END, CASE WHEN step % 3 < 0 THEN 'shard_index' END, CASE WHEN step - 3 < 0 THEN 'record_offset' END,
            CASE WHEN step % 4 >= 3 THEN 'rank-of-world' END], lambda x: x IS NOT NULL), ',') AS violations, step - 2 AS next_record FROM training_metrics WHERE step IS NOT NULL""",
        "shard_totals": "SELECT count(*) AS shards, sum(records)::BIGINT AS records, CASE WHEN count(*) = count(tokens) THEN sum(tokens)::BIGINT END AS tokens FROM (SELECT source, count(*) AS records, CASE WHEN count(*) = count(n_chars) THEN sum(n_chars)::BIGINT END AS tokens FROM documents GROUP BY 1)",
        "perplexity": "SELECT DISTINCT loss, round(exp(least(loss, 80.0)), 6) AS perplexity FROM training_metrics WHERE loss IS NOT NULL",
        "step_horizon": "SELECT DISTINCT tokens_processed, ceil(tokens_processed / 4096)::BIGINT AS steps FROM training_metrics WHERE tokens_processed IS NOT NULL",
        "batches": "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) - 1) // 32 AS batch_no FROM documents",
        "epochs": "SELECT e.e::INT AS epoch, id FROM completion_tasks, (SELECT unnest([0, 1, 2]) AS e) e",
        "resume": "SELECT doc_id FROM documents WHERE doc_id // 100 > 3 OR (doc_id // 100 = 3 AND doc_id % 100 >= 41)",
        "supervised_tokens": "SELECT id, len(list_filter(list_transform(string_split(prompt, ''), lambda c: unicode(c))[2:], lambda x: x <> -100 AND x <> 32))::INT AS supervised FROM completion_tasks",
        "infilling_prompts": "SELECT id, sha256('<fim_prefix>' || prefix || '<fim_suffix>' || suffix || '<fim_middle>') AS prompt_sha256 FROM fim_tasks",
        "byte_tokens": "SELECT id, array_to_string(list_transform(range(1, 2 * strlen(prompt), 2), lambda i: ('0x' || substr(hex(encode(prompt)), i, 2))::INT % 200), ',') AS ids FROM completion_tasks",
        "objective_counts": f"SELECT count(*) FILTER (WHERE NOT f) AS causal_examples, count(*) FILTER (WHERE f) AS fim_examples, coalesce(sum(length(text)) FILTER (WHERE NOT f), 0)::BIGINT AS causal_tokens, coalesce(sum(length(text)) FILTER (WHERE f), 0)::BIGINT AS fim_tokens FROM (SELECT text, {fim} AS f FROM {documents} WHERE record_id IS NOT NULL)",
        "diagnostic_counts": f"SELECT coalesce(sum(len(exclusion_reasons)), 0)::BIGINT AS exclusion_reasons FROM {RECORDS}",
        "unapproved_sources": "SELECT DISTINCT source_id, commit_sha FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM approvals a WHERE a.status = 'approved' AND a.source_id = r.source_id AND a.commit_sha = r.commit_sha)",
        "included_documents": f"SELECT record_id, count(*) AS rows FROM {RECORDS} WHERE included AND split = 'train' GROUP BY 1",
        "owned_records": "SELECT doc_id FROM documents WHERE record_id IS NOT NULL AND ('0x' || substr(sha256(record_id), 1, 16))::UHUGEINT % 5 = 2",
        "snapshot_digests": f"""WITH f AS (SELECT lower(trim(repository_id)) AS repository_id, relative_path, min(size_bytes) AS b, min(content_sha256) AS c FROM {RECORDS} WHERE repository_id IS NOT NULL AND relative_path IS NOT NULL AND content_sha256 IS NOT NULL AND size_bytes IS NOT NULL GROUP BY 1, 2)
          SELECT repository_id, sha256(string_agg('regular' || chr(0) || relative_path || chr(0) || b || chr(0) || c || chr(10), '' ORDER BY relative_path)) AS tree_sha256, count(*) AS file_count, sum(b)::BIGINT AS total_bytes,
            count(*) FILTER (WHERE regexp_matches(lower({NAME}), '^(?:license|copying)'))::INT AS licenses FROM f GROUP BY 1""",
    }
