"""The registered queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, licenses, lloyd, manifest, minhash, mixing, pages, repeats, scoring, secrets, tokens, topk, toxicity
from .common import read


def op1_html_extraction(spark, sf_dir):
    return pages.extract(read(spark, sf_dir, "pages"))


def op4_exact_topk(spark, sf_dir):
    return topk.nearest(read(spark, sf_dir, "embeddings"))


_OP4_SQL = """
with v as (select row_number() over () id, vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)) q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id, a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint score from v a join v b on a.vec_id % 50 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def op8_license_scans(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def _op8_sql():
    """Phrases by position; templates as regular expressions over the words; score from the share of mandatory words."""
    phrases = ", ".join(f"list_transform(list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: w[i + 1:i + {len(p.split())}] = [{', '.join(f"'{x}'" for x in p.split())}]), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in licenses.PHRASES)
    accepted = ", ".join(f"case when regexp_matches(line, '{licenses.as_regex(markup)}') then '{label}' end" for label, markup in licenses.TEMPLATES)
    shares = ", ".join(f"len(list_intersect(w, [{', '.join(f"'{x.decode()}'" for x in sorted(a.needs))}])) / {len(a.needs)}" for a in licenses.AUTOMATA)
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
l as (select *, ' ' || array_to_string(w, ' ') || ' ' line from d),
p as (select *, flatten([{phrases}]) places, list_filter([{accepted}], lambda x: x is not null) found, list_max([{shares}]) share from l)
select doc_id, len(w)::bigint n_words, len(places)::bigint n_base, list_min(list_transform(places, lambda x: x.at))::bigint first_word, list_max(list_transform(places, lambda x: x.at))::bigint last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), found))), ',') labels,
  case when len(places) > 0 or len(found) > 0 then 1.0::double when share >= 0.5 then 0.5 * share else 0.0::double end score from p"""


def op9_lm_scoring(spark, sf_dir):
    return scoring.score(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


_OP6_SQL = """
with d as (select row_number() over (order by doc_id nulls first) r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
p as (select r, unnest(range(0, len(x) // 2 - 99)) i, x from d where len(x) >= 200),
g as (select r, i, md5(substr(x, 2 * i + 1, 200)) h from p),
f as (select h, min({'r': r, 'i': i}) least from g group by h having count(*) > 1),
c as (select r, i, case when i <= lag(i) over (partition by r order by i) + 100 then 0 else 1 end opens from g join f using (h) where {'r': r, 'i': i} <> least),
n as (select r, i, sum(opens) over (partition by r order by i) run from c),
s as (select r, run, min(i) b, max(i) + 100 e from n group by r, run),
k as (select r, run, b, e, coalesce(lag(e) over (partition by r order by run), 0) before, row_number() over (partition by r order by run desc) = 1 ends from s),
t as (select k.r, sum(e - b) gone, count(*) runs, string_agg(substr(x, 2 * before + 1, 2 * (b - before)) || case when ends then substr(x, 2 * e + 1) else '' end, '' order by run) kept from k join d using (r) group by k.r)
select doc_id, (len(x) // 2)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(runs, 0)::bigint n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256 from d left join t using (r)"""


def op2_secret_scans(spark, sf_dir):
    spans = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["kind"] < len(secrets.BASE))

    def of(k):
        return F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")

    count = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return spans.select("doc_id", *count, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("__spans")).alias("spans"))


def _op2_sql():
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    parts, spans = [], []
    for k, r in enumerate(secrets.RULES):
        parts.append(f"""select id, {k} k, {q(r.kind)} kind, string_split_regex(t, {q(r.pattern)}) a, regexp_extract_all(t, {q(r.pattern)}) h, regexp_extract_all(t, {q(r.pattern)}, {r.group}) g, {r.least} least from d""")
    return f"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
m as ({' union all '.join(parts)}),
e as (select id, k, kind, least, unnest(range(1, len(h) + 1)) i, a, h, g from m where len(h) > 0),
s as (select id, k, kind, list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) b, length(h[i]) n, length(g[i]) gl, least from e),
w as (select id, k, kind, kind || ':' || b::bigint || ':' || (b + n)::bigint w, b from s where gl >= least),
o as (select id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
  coalesce(string_agg(w, ',' order by b, k) filter (k < 3), '') base, string_agg(w, ',' order by b, k) spans from w group by id)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join o using (id)"""


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def _op3_sql():
    """The same masks at every place, items of few tokens by single ones; each alignment that they tell is compared once."""

    def keys(masks):
        return ", ".join(f"'{k}:' || concat_ws(' ', " + ", ".join(f"w[p + {i + 1}]" for i, c in enumerate(m) if c == "1") + ")" for k, m in enumerate(masks))

    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    brief, whole = keys(decontaminate.SINGLE), keys(decontaminate.TRIPLES)
    return rf"""
with d as (select row_number() over () id, doc_id, {words} w from documents),
b as (select item_id, {words} w from benchmark),
bp as (select item_id, w, unnest(range(0, len(w))) p from b),
bk as (select item_id, p, 's' s, unnest([{brief}]) k from bp where len(w) < {decontaminate.SHORT} union all select item_id, p, 't', unnest([{whole}]) from bp where len(w) >= {decontaminate.SHORT}),
dp as (select id, w, unnest(range(0, len(w))) p from d),
dk as (select id, p, 't' s, unnest([{whole}]) k from dp union all select id, p, 's', unnest([{brief}]) from dp),
h as (select distinct dk.id, bk.item_id, dk.p - bk.p s from dk join bk using (s, k)),
a as (select h.id, h.item_id, h.s, len(b.w) n_item, len(list_filter(range(0, len(b.w)), lambda j: h.s + j >= 0 and coalesce(d.w[h.s + j + 1] = b.w[j + 1], false))) n_same
  from h join d using (id) join b using (item_id)),
r as (select *, row_number() over (partition by id, item_id order by n_same desc, s) rn from a where n_same >= {decontaminate.LEAST} * n_item)
select d.doc_id, item_id, s::int doc_start, n_item::int n_item, n_same::int n_same, n_same / n_item share from r join d using (id) where rn = 1"""


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


_OP5_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
e as (select a.doc_id x, b.doc_id y from s a join s b using (g) join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id where a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
l as (select x, y from e union all select y, x from e),
r as (select doc_id a, doc_id z from d union select l.y, r.z from r join l on l.x = r.a where r.z < l.y),
c as (select a, min(z) z from r group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, z component_id, z = doc_id kept from d left join n using (doc_id) join c on c.a = doc_id"""


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    graded = toxicity.grade(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    chance = F.col("__at_least")[0]
    return graded.select("doc_id", F.col("__severity").alias("expected_severity"), chance.alias("p_toxic"), F.col("__at_least")[1].alias("p_severe"), (chance >= toxicity.REJECT).alias("toxic"))


def op11_vector_codes(spark, sf_dir):
    codes, books = lloyd.compress(read(spark, sf_dir, "embeddings"))
    told = lloyd.with_label_errors(codes).withColumn("codebooks_sha256", F.lit(lloyd.digest(books)))
    return told.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _op11_sql():
    """Every distance in every round. Entries are lists by part; the first of the nearest is the one with the least (distance, entry)."""
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) ** 2))::bigint"

    def assigned(k):
        return f"a{k} as materialized (select row, p, any_value(x) x, min({{'d': {apart}, 'e': e}}) n from v join c{k} using (p) group by row, p)"

    def replaced(k):
        return f"""s{k} as (select p, e, i, floor(sum(y)::double / count(*))::bigint y from (select p, n.e e, generate_subscripts(x, 1) i, unnest(x) y from a{k}) group by p, e, i),
c{k + 1} as materialized (select p, e, coalesce(m, c) c from c{k} left join (select p, e, list(y order by i) m from s{k} group by p, e) using (p, e))"""

    rounds = ", ".join(f"{assigned(k)}, {replaced(k)}" for k in range(lloyd.ROUNDS))
    return rf"""
with k as (select row_number() over (order by vec_id nulls last, embedding) row, vec_id, label, list_transform(embedding, lambda x: floor({lloyd.SCALE} * x::double)::bigint) x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select * from k where len(x) = (select len(x) from k where len(x) % {lloyd.PARTS} = 0 order by row limit 1)),
v as (select row, p, x[p * len(x) // {lloyd.PARTS} + 1:(p + 1) * len(x) // {lloyd.PARTS}] x from w, range({lloyd.PARTS}) t(p)),
c0 as (select p, row_number() over (partition by p order by row) - 1 e, x c from v qualify e < {lloyd.ENTRIES}),
{rounds}, {assigned(lloyd.ROUNDS)},
o as (select row, string_agg(lpad(lower(to_hex(n.e)), 2, '0'), '' order by p) code, sum(n.d)::bigint error from a{lloyd.ROUNDS} group by row)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  sha256((select string_agg(y::varchar, ',' order by p, e, i) from (select p, e, generate_subscripts(c, 1) i, unnest(c) y from c{lloyd.ROUNDS}))) codebooks_sha256
from o join w using (row)"""


def op12_merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", *manifest.FIELDS[1:], "text")
    halved = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    proved = manifest.manifest(docs, F.when(halved, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    told = proved.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": manifest.fold(F.col("seen_leaf"), F.col("path"))})
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op12_sql():
    """The tree level by level as lists of digests, a row's path by its place in them; crc32 bit by bit."""
    plain = "'-'"
    told = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, {plain})" for c in manifest.FIELDS)

    def leaf(text):
        return f"sha256({told} || coalesce(strlen({text}) || ':' || {text}, {plain}))"

    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"

    def tree(name, start):
        up = "list_transform(range((len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1:3 * i + 3], '')))"
        return f"{name} as ({start} union all select g, h + 1, {up} from {name} where len(l) > 1)"

    def path(name, start, of):
        node = f"select p.row, p.g, p.i, p.h, t.l[3 * (p.i // 3) + 1:p.i] a, t.l[p.i + 2:3 * (p.i // 3) + 3] z from {{}} p join {of} t on t.g is not distinct from p.g and t.h = p.h where len(t.l) > 1"
        return f"{name} as ({node.format('(' + start + ')')} union all {node.format(f'(select row, g, i // 3 i, h + 1 h from {name})')})"

    return rf"""
with recursive d as (select *, {leaf("text")} leaf, case when {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end seen from documents),
e as (select *, row_number() over (order by source nulls first, doc_id nulls first, leaf) row, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i from d),
{tree("t", "select source g, 0 h, list(leaf order by i) l from e group by source")},
{path("p", "select row, source g, i, 0 h from e", "t")},
s as (select g, l[1] subroot, row_number() over (order by g nulls first) - 1 i from t where len(l) = 1),
{tree("u", "select 0 g, 0 h, list(subroot order by i) l from s")},
{path("q", "select i row, 0 g, i, 0 h from s", "u")},
w as (select p.row, p.h, a, z from p union all select e.row, 1000 + q.h, a, z from q join s on s.i = q.row join e on e.source is not distinct from s.g),
y as (select row, list({{'a': array_to_string(a, ''), 'z': array_to_string(z, '')}} order by h) steps from w group by row),
f as (select e.*, coalesce(steps, []) steps from e left join y using (row)),
k as (select *, list_reduce(list_prepend({{'a': seen, 'z': ''}}, steps), lambda x, n: {{'a': sha256(n.a || x.a || n.z), 'z': ''}}).a folded_root, (select l[1] from u where len(l) = 1) root from f)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.a || x.z), '')) proof_sha256, folded_root, folded_root = root verified
from k join s on s.g is not distinct from k.source"""


def op13_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def _op10_sql():
    w = mixing.WEIGHTS
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double u from documents),
s as (select source, sum(size)::bigint source_size, case (row_number() over (order by source is null, source) - 1) % {len(w)} when 0 then {w[0]}.0 when 1 then {w[1]}.0 else {w[2]}.0 end::double wt from d group by source),
f as (select *, {mixing.CAP}::double * source_size full_, {mixing.SHARE}::double * sum(source_size) over () total from s),
v as (select distinct (a.total - coalesce((select sum(b.full_) from f b where b.full_ / b.wt < a.full_ / a.wt), 0)) / (select sum(b.wt) from f b where b.full_ / b.wt >= a.full_ / a.wt) level, a.total from f a),
x as (select level from v order by abs(total - (select sum(least(full_, level * wt)) from f)), level limit 1),
t as (select source, source_size, least(full_, coalesce((select level from x), 0) * wt) target from f),
e as (select d.*, source_size, target, least({mixing.CAP}::double, case when source_size > 0 then target / source_size else 0 end) e from d join t on d.source is not distinct from t.source),
p as (select *, floor(e) whole, e - floor(e) p from e),
r as (select *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) rank, case when whole + 1 <= {mixing.CAP} then size else 0 end extra from p),
c as (select *, target - sum(whole * size) over (partition by source) need, sum(extra) over (partition by source order by rank, u, doc_id, size range unbounded preceding) upto, sum(extra) over (partition by source, rank, u, doc_id, size) alike from r)
select doc_id, size::bigint size, source_size, target, (size * (whole + case when extra > 0 and upto - alike / 2 <= need then 1 else 0 end))::bigint taken from c"""


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_secret_scans, op3_benchmark_decontamination, op4_exact_topk, op5_minhash_near_dedup, op6_suffix_dedup, op7_toxicity, op8_license_scans, op9_lm_scoring, op10_source_mixing, op11_vector_codes, op12_merkle_manifest, op13_token_counts)}
SQL = {"op2_secret_scans": _op2_sql(), "op3_benchmark_decontamination": _op3_sql(), "op4_exact_topk": _OP4_SQL, "op5_minhash_near_dedup": _OP5_SQL, "op6_suffix_dedup": _OP6_SQL, "op8_license_scans": _op8_sql(), "op10_source_mixing": _op10_sql(), "op11_vector_codes": _op11_sql(), "op12_merkle_manifest": _op12_sql()}
