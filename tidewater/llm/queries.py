"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, fingerprint, langid, licenses, lines, manifest, mil, packing, pii, quality_rules, secret_scan, simhash, vector_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), F.coalesce(_fold(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model).withColumn("held_out", held)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 on instruction data: conversations, or chains of their turns, under limits on tokens, segments and loss-bearing tokens."""
    return packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_with_edit(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text("fp").alias("fingerprint"),
        fingerprint.as_text("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), F.coalesce(_fold(5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = mil.fit(docs, labels.where(~held))
    scored = mil.score(docs, model)
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = bpe.encode_decode(documents(spark, sf_dir))
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(written).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = vector_codes.with_label_error(coded)
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.manifest(manifest.leaf_digests(documents(spark, sf_dir)))
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("edited_leaf", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_language": op2_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_lines": op9_lines,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_manifest": op12_manifest,
    "op13_secrets": op13_secrets,
    "conversation_packing": conversation_packing,
}

#: ASCII white space, and A-Z lower-cased, as SQL.
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(licenses.TEMPLATES.items()))
_NORMAL = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"

_CLASSES = {"lower": r"[\p{L}\p{M}]", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:'\"\-()?]", "symbol": r"[#*$%&|<>]", "all": r"[^\x20\x09-\x0D]"}
_COUNTS = ", ".join("len(regexp_extract_all(t, '{}')) as c_{}".format(c.replace("'", "''"), k) for k, c in _CLASSES.items())
#: Base 2; the sums of each class or word, nothing for those that one side lacks.
_JSD = "sqrt(greatest(0, sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)))"


def _vector_codes_sql() -> str:
    """A pair of tables for each round: the nearest entry of each part, and the entries moved."""
    steps = [
        f"""kept as materialized (
            select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({vector_codes.SCALE} * cast(x as double)) as bigint)) as v
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        part as materialized (
            select r, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] as x from kept, range({vector_codes.PARTS}) t(p)),
        book0 as materialized (select p, r - 1 as e, x as y from part where r <= {vector_codes.ENTRIES})"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{k} as materialized (
            select r, p, min({{'d': cast(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), 'e': e}}) as hit
            from part join book{k} using (p) group by r, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""book{k + 1} as materialized (
                with piece as (select p, hit.e as e, unnest(x) as x, generate_subscripts(x, 1) as i from part join near{k} using (r, p)),
                mean as (select p, e, i, cast(floor(sum(x) / count(*)) as bigint) as m from piece group by p, e, i),
                moved as (select p, e, list(m order by i) as y from mean group by p, e)
                select p, e, coalesce(m.y, b.y) as y from book{k} b left join moved m using (p, e))""")
    return f"""with {", ".join(steps)},
        books as (select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as codebooks_sha256 from book{vector_codes.ROUNDS}),
        coded as (select r, string_agg(printf('%02x', hit.e), '' order by p) as code, cast(sum(hit.d) as bigint) as error from near{vector_codes.ROUNDS} group by r)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (r), books"""


def _manifest_sql(leaf_levels: int = 8, group_levels: int = 4) -> str:
    """Levels one by one, for up to 8 ** 8 rows of a language and 8 ** 4 languages; a tree that is done stays as it is."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    hashed = lambda text: f"sha256({' || '.join([*map(field, ('doc_id', 'source', 'lang', 'n_chars')), field(text)])})"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    steps = [
        f"""leaf as materialized (select row_number() over () as r, doc_id, lang, {hashed('text')} as leaf,
                case when ({crc}) % 3 = 0 then {hashed(_LOWER.format('text'))} else {hashed('text')} end as edited from documents)""",
        "n0 as materialized (select r, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, leaf as h from leaf)",
    ]
    # n: nodes; w: each row's node with its siblings.
    for k in range(leaf_levels):
        many = "count(*) over (partition by g) > 1"
        steps.append(f"""m{k} as materialized (select g, i, h, i // 8 as up, {many} as many from n{k})""")
        steps.append(f"""s{k} as materialized (select g, i, many, coalesce(string_agg(h, '' order by i) over (partition by g, up order by i rows between unbounded preceding and 1 preceding), '') as l,
                coalesce(string_agg(h, '' order by i) over (partition by g, up order by i rows between 1 following and unbounded following), '') as r from m{k})""")
        steps.append(f"n{k + 1} as materialized (select g, up as i, case when any_value(many) then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from m{k} group by g, up)")
    steps.append(f"t0 as materialized (select '' as g, row_number() over (order by g) - 1 as i, h, g as lang from n{leaf_levels})")
    for k in range(group_levels):
        steps.append(f"tm{k} as materialized (select i, h, i // 8 as up, count(*) over () > 1 as many from t{k})")
        steps.append(f"""ts{k} as materialized (select i, many, coalesce(string_agg(h, '' order by i) over (partition by up order by i rows between unbounded preceding and 1 preceding), '') as l,
                coalesce(string_agg(h, '' order by i) over (partition by up order by i rows between 1 following and unbounded following), '') as r from tm{k})""")
        steps.append(f"t{k + 1} as materialized (select up as i, case when any_value(many) then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from tm{k} group by up)")
    fold = "case when s.many then sha256(s.l || f || s.r) else f end as f, case when s.many then proof || s.l || s.r else proof end as proof"
    steps.append("f0 as materialized (select n0.r, n0.g, n0.i, edited as f, '' as proof, t0.h as subroot, t0.i as ti from n0 join leaf using (r) join t0 on t0.lang = n0.g)")
    for k in range(leaf_levels):
        steps.append(f"f{k + 1} as materialized (select f{k}.r, f{k}.g, f{k}.i // 8 as i, {fold}, subroot, ti from f{k} join s{k} s on s.g = f{k}.g and s.i = f{k}.i)")
    steps.append(f"g0 as materialized (select r, ti as i, f, proof, subroot from f{leaf_levels})")
    for k in range(group_levels):
        steps.append(f"g{k + 1} as materialized (select g{k}.r, g{k}.i // 8 as i, {fold}, subroot from g{k} join ts{k} s on s.i = g{k}.i)")
    return f"""with {", ".join(steps)}
        select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified
        from leaf join g{group_levels} using (r), t{group_levels}"""


ORACLE: dict[str, str] = {
    "op12_manifest": _manifest_sql(),
    "op11_vector_codes": _vector_codes_sql(),
    "op3_quality_rules": f"""
        with doc as (select doc_id, lang, coalesce(text, '') as t from documents),
        split as (select doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, {_COUNTS} from doc),
        repeated as (select distinct doc_id, i + k as at
                     from (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i : i + 4], ' ')) as n
                           from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from split)), range(5) r(k) where n > 1),
        covered as (select doc_id, count(*) as n from repeated group by doc_id),
        lines as (select doc_id, count(*) - count(distinct line) as n
                  from (select doc_id, unnest(string_split(t, chr(10))) as line from doc)
                  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
        base as (select s.*, len(ws) as n_words, c_all as word_chars, c_symbol as n_symbols,
                        coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
                        len(ws) < 10 or 100 * coalesce(c.n, 0) > 20 * len(ws) as base_failed
                 from split s left join lines l using (doc_id) left join covered c using (doc_id)),
        chars as (select doc_id, lang, n_words, base_failed, unnest(range(6)) as k,
                         unnest([c_lower - c_upper, c_upper, c_digit, c_stop, c_symbol, c_all - c_lower - c_digit - c_stop - c_symbol])
                         / greatest(1, c_all) as p from base),
        plain as (select doc_id, unnest(regexp_extract_all({_LOWER.format("t")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from doc),
        total as (select doc_id, count(*) as n from plain group by doc_id),
        counted as (select doc_id, w, count(*) as n from plain group by all),
        fit as (select doc_id, lang from base where not base_failed and n_words >= {quality_rules.REFERENCE_WORDS} and lang in (select lang from documents where text is not null group by lang having count(*) >= {quality_rules.REFERENCE_TEXTS})),
        ranked as (select lang as ref, w, row_number() over (partition by lang order by sum(1000000 * c.n // t.n) desc, w) - 1 as k
                   from fit join counted c using (doc_id) join total t using (doc_id) group by lang, w),
        common as (select * from ranked where k < {quality_rules.LEARNED_WORDS}),
        langs as (select lang as ref, (select count(*) from common c where c.ref = lang) as last from fit group by lang having count(*) >= {quality_rules.REFERENCE_TEXTS}),
        hits as (select doc_id, ref, k, n from counted join common using (w)),
        slots as (select doc_id, lang, ref, k, last from base, langs, range({quality_rules.LEARNED_WORDS + 1}) r(k) where k <= last),
        found as (select s.*, coalesce(h.n, 0) as n, coalesce(t.n, 0) as all_n from slots s left join hits h using (doc_id, ref, k) left join total t using (doc_id)),
        words as (select *, case when k < last then n else all_n - sum(n) over (partition by doc_id, ref) end / greatest(1, all_n) as p from found),
        fit_chars as (select lang as ref, k, avg(p) as q from chars where doc_id in (select doc_id from fit) and lang in (select ref from langs) group by all),
        fit_words as (select ref, k, avg(p) as q from words where doc_id in (select doc_id from fit) and lang = ref group by all),
        char_far as (select doc_id, min(d) as far from (select doc_id, ref, {_JSD} as d from chars join fit_chars using (k) group by all) group by doc_id),
        word_far as (select doc_id, min(d) as far from (select doc_id, ref, {_JSD} as d from words join fit_words using (ref, k) group by all) group by doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and (b.ref is null or not (
               coalesce(n_words >= {quality_rules.CHAR_GUARD} and c.far > {quality_rules.CHAR_LIMIT[0]} + {quality_rules.CHAR_LIMIT[1]} / sqrt(n_words), false)
               or coalesce(n_words >= {quality_rules.WORD_GUARD} and w.far > {quality_rules.WORD_LIMIT[0]} + {quality_rules.WORD_LIMIT[1]} / sqrt(n_words), false))) as kept
        from (select base.*, langs.ref from base left join langs on langs.ref = base.lang) b left join char_far c using (doc_id) left join word_far w using (doc_id)""",
    "op1_licenses": f"""
        with template as (select license, {_NORMAL} as ws from (values {_VALUES}) v(license, text)),
        sized as (select license, ws, least(5, len(ws)) as width from template),
        wanted as (select distinct license, width, array_to_string(ws[i : i + width - 1], ' ') as s
                   from (select *, unnest(range(1, len(ws) - width + 2)) as i from sized)),
        total as (select license, count(*) as n_shingles from wanted group by license),
        doc as (select doc_id, {_NORMAL} as ws from documents),
        held as (select distinct doc_id, width, array_to_string(ws[i : i + width - 1], ' ') as s
                 from (select doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) as i
                       from doc, (select distinct width from sized)))
        select doc_id, license, n_shingles, count(*) as n_found, count(*) / n_shingles as containment
        from held join wanted using (width, s) join total using (license)
        group by doc_id, license, n_shingles having count(*) / n_shingles >= 0.8""",
    "op9_lines": f"""
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        line as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from split),
        keyed as (select *, {_LOWER.format(f"trim(line, {_SPACE})")} as k from line),
        often as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
        select doc_id, count(*) as n_lines, count(*) filter (where o.k is not null) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where o.k is null), '')) as kept_sha256
        from keyed left join often o using (k) group by doc_id""",
}
