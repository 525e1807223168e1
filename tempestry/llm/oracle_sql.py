"""DuckDB SQL for the results of the tree and resampling operators, over the given tables."""

from tempestry.llm import kd_shards, merkle, resample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CRC_TABLE = "[" + ",".join(map(str, resample.CRC_TABLE.tolist())) + "]::UINTEGER[]"


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes."""
    listed = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UINTEGER)"
    step = f"lambda a, b: xor(({CRC_TABLE})[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce({listed}, {step}, 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT"


def kd_sql(levels=4) -> str:
    """2 ** levels shards: each level cuts every node at the weighted median of its widest dimension."""
    numbers = ["doc_id::DOUBLE", "n_chars::DOUBLE"]
    numbers += [f"('0x' || rpad(left(hex(encode({c})), 12), 12, '0'))::BIGINT::DOUBLE" for c in ("source", "lang")]
    dims = [f"d{i}" for i in range(len(kd_shards.DIMENSIONS))]
    parts = [
        "rows AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, "
        + ", ".join(f"coalesce({n}, 0) AS {d}" for n, d in zip(numbers, dims))
        + ", ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 13))::BIGINT AS tie FROM documents)",
        "whole AS (SELECT " + ", ".join(f"max({d}) - min({d}) AS r_{d}" for d in dims) + " FROM rows)",
        "n0 AS (SELECT *, 0 AS node FROM rows)",
    ]
    for level in range(levels):
        extents = [f"coalesce((max({d}) - min({d})) / nullif(any_value(r_{d}), 0), 0)" for d in dims]
        value = "CASE dim " + " ".join(f"WHEN {i + 1} THEN {d}" for i, d in enumerate(dims)) + " END"
        parts += [
            f"f{level} AS (SELECT node, sum(size) AS total, list_position([{', '.join(extents)}], list_max([{', '.join(extents)}])) AS dim"
            f" FROM n{level}, whole GROUP BY node)",
            f"s{level} AS (SELECT * EXCLUDE (total, dim), total, sum(size) OVER (PARTITION BY node ORDER BY {value}, tie ROWS UNBOUNDED PRECEDING) AS upto"
            f" FROM n{level} JOIN f{level} USING (node))",
            f"n{level + 1} AS (SELECT * EXCLUDE (node, total, upto), 2 * node + CASE WHEN 2 * upto - size <= total THEN 0 ELSE 1 END AS node FROM s{level})",
        ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, size::BIGINT AS size, {crc32('t')} AS text_crc32, 'bytes' AS law, node::INTEGER AS shard,"
        f" row_number() OVER (PARTITION BY node ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM n{levels}"
    )


def resample_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    both = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    b, p = resample.BUCKETS, resample.PERCENT
    return f"""
WITH ours AS (SELECT doc_id, {words} AS w FROM documents),
theirs AS (SELECT {words} AS w FROM benchmark),
said AS (SELECT doc_id, len(w) AS n_words, unnest({both}) AS feature FROM ours),
wanted AS (SELECT unnest({both}) AS feature FROM theirs),
buckets AS (SELECT feature, {crc32('feature')} % {b} AS bucket FROM (SELECT feature FROM said UNION SELECT feature FROM wanted)),
s AS (SELECT bucket, count(*) AS n FROM said JOIN buckets USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + {b})::DOUBLE
                                 / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {b})::DOUBLE))) AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM said JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{resample.SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM ours LEFT JOIN weights USING (doc_id)
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= {resample.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {p} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""


def merkle_sql(own_levels=5, top_levels=3) -> str:
    """Trees of at most 16 ** own_levels rows a source and 16 ** top_levels sources; done trees keep their last node."""
    fan = merkle.FANOUT

    def field(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c if c != "text" else text) for c in merkle.LEAF_COLUMNS) + ")"

    parts = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0"
        f" THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS start FROM documents)",
        "sources AS (SELECT source, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) AS tree FROM (SELECT DISTINCT source FROM leaves))",
        "a0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, leaf AS hash, doc_id, start"
        " FROM leaves JOIN sources ON leaves.source IS NOT DISTINCT FROM sources.source)",
    ]

    def climb(name, levels):
        """Tables name{l} of nodes and x{name}{l} of nodes with their siblings left and right and their parent's place."""
        for n in range(levels):
            run = f"PARTITION BY tree, place // {fan} ORDER BY place ROWS BETWEEN"
            parts.append(
                f"x{name}{n} AS (SELECT *, place // {fan} AS up, count(*) OVER (PARTITION BY tree) AS total,"
                f" coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{n})"
            )
            parts.append(
                f"{name}{n + 1} AS (SELECT tree, up AS place, CASE WHEN any_value(total) = 1 THEN any_value(hash)"
                f" ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash FROM x{name}{n} GROUP BY tree, up)"
            )

    climb("a", own_levels)
    parts.append(f"b0 AS (SELECT 0 AS tree, tree - 1 AS place, hash, tree AS source_tree FROM a{own_levels})")
    climb("b", top_levels)

    def folded(node, x):
        return f"CASE WHEN {x}.total = 1 THEN {node} ELSE sha256({x}.l || {node} || {x}.r) END"

    columns = "doc_id, a.hash AS leaf, a.tree, a.place"
    parts.append(f"p0 AS (SELECT {columns}, start AS node, '' AS proof FROM a0 a)")
    for n in range(own_levels):
        parts.append(
            f"p{n + 1} AS (SELECT p.doc_id, p.leaf, p.tree, x.up AS place, {folded('p.node', 'x')} AS node, p.proof || x.l || x.r AS proof"
            f" FROM p{n} p JOIN xa{n} x ON p.tree = x.tree AND p.place = x.place)"
        )
    parts.append(
        f"q0 AS (SELECT p.doc_id, p.leaf, p.node, p.proof, b.hash AS subroot, b.place FROM p{own_levels} p JOIN b0 b ON p.tree = b.source_tree)"
    )
    for n in range(top_levels):
        parts.append(
            f"q{n + 1} AS (SELECT p.doc_id, p.leaf, {folded('p.node', 'x')} AS node, p.proof || x.l || x.r AS proof, p.subroot, x.up AS place"
            f" FROM q{n} p JOIN xb{n} x ON p.place = x.place)"
        )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified"
        f" FROM q{top_levels}, (SELECT hash AS root FROM b{top_levels})"
    )
