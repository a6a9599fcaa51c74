"""The registered queries: each operator on its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, chat, collocations, decontam, jaccard, linededup, nbsvm, packing, pii, pseudolm, rules, simhash, warc
from tessera.llm.common import read, text_of


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted; digests are read back from the output."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(probe).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows)
    back = out.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("segments")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = r"""regexp_replace({0}, '(\[INST|\[/INST|\[SEP|</s)(\\*)([\]>])', '\1\2\\\3', 'g')"""

OP1_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, row_number() over w as i, lag(role) over w as before, lead(role) over w as after
  from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESC.format('text')})
    + case when before is distinct from role then 13 + length({_ESC.format('role')}) else 5 end
    + case when after is distinct from role then 4 else 0 end) as bigint) as formatted_chars
from o group by conv_id
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.train(docs))
    return found.select(
        "doc_id",
        "pii.n_email",
        "pii.n_ip",
        "pii.n_card",
        "pii.n_phone",
        F.sha2("pii.base", 256).alias("base_sha256"),
        "pii.spans",
    )


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that learned from the rows not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    scored = nbsvm.with_score(docs, model)
    return scored.select(
        "doc_id",
        nbsvm.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_pseudolm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = pseudolm.vocabulary(docs)
    scored = pseudolm.with_score(docs, words, pseudolm.train(docs, words), keep=["doc_id"])
    n, total = F.col("lm.n_words"), F.col("lm.log_likelihood")
    return scored.select(
        "doc_id", n, total, F.when(n > 0, total / n).alias("mean_log_likelihood")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, 1024), 1024)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule metrics and verdict of every document; cutoffs learned from all labels."""
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


OP9_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first_page from p where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, p.payload_digest,
       case when first_page is null or first_page = page_id then 'response' else 'revisit' end as record_type,
       case when first_page <> page_id then first_page end as refers_to
from p left join f on p.payload_digest = f.payload_digest and payload_bytes >= 100
"""


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


OP10_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), f as (
  select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f using (key) group by doc_id
"""

def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids of two tokenizers aligned, with corpus-wide counts of linked id pairs."""
    return align.align_corpus(read(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets of every document linked at a Jaccard similarity of 0.9, by component."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=90)


OP12_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as sh
  from d
), g as materialized (
  select doc_id, len(sh) as n, unnest(sh) as t from s
), o as materialized (
  select doc_id, n, hash(t) as t, row_number() over (partition by doc_id order by f, t) as pos
  from (select *, count(*) over (partition by t) as f from g)
), c as materialized (
  select distinct a.doc_id as a, b.doc_id as b
  from o a join o b on a.t = b.t and a.doc_id < b.doc_id
  where a.pos <= a.n - ceil(a.n * 0.9) + 1 and b.pos <= b.n - ceil(b.n * 0.9) + 1
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), e as materialized (
  select a, b from (
    select c.a, c.b, len(x.sh) as na, len(y.sh) as nb, len(list_intersect(x.sh, y.sh)) as shared
    from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b
  ) where 100 * shared >= 90 * (na + nb - shared)
), r(node, reach) as (
  select doc_id, doc_id from s
  union
  select r.node, case when e.a = r.reach then e.b else e.a end from r join e on r.reach in (e.a, e.b)
)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(r.reach) as component_id
from s join r on r.node = s.doc_id group by s.doc_id, len(s.sh)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best-scoring phrases of two to four words over all documents."""
    return collocations.collocations(read(spark, sf_dir, "documents"), least=30, percent=80, top=2000)


_SPLIT13 = r"""string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))"""

OP13_SQL = f"""
with p as (
  select coalesce(lang, 'und') as lang, unnest({_SPLIT13}) as piece from documents
), t as materialized (
  select lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') as w from p
), f as materialized (
  select lang, ph, len(ph) as k, count(*) as c from (
    select lang, unnest(flatten(list_transform(range(1, 5), lambda k:
      list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))))) as ph from t
  ) group by all having count(*) >= 30
), cuts as (
  select f.lang, f.ph, f.k, f.c as a, unnest(range(1, f.k)) as cut from f where f.k >= 2
), s as (
  select cuts.*, x.c as l, y.c as r, (2000000::hugeint * a) // (x.c::hugeint + y.c) as score
  from cuts join f x on x.lang = cuts.lang and x.ph = list_slice(cuts.ph, 1, cut)
            join f y on y.lang = cuts.lang and y.ph = list_slice(cuts.ph, cut + 1, cuts.k)
), b as (
  select * from s qualify row_number() over (partition by lang, ph order by score, cut) = 1
), inner_ as (
  select lang, ph, max(c) as longer from (
    select lang, c, unnest(flatten(list_transform(range(2, k), lambda z:
      list_transform(range(1, k - z + 2), lambda i: list_slice(ph, i, i + z - 1))))) as ph from f where k >= 3
  ) group by all
), kept as (
  select b.*, array_to_string(b.ph, ' ') as phrase from b left join inner_ i on i.lang = b.lang and i.ph = b.ph
  where i.longer is null or 100::hugeint * i.longer < 80::hugeint * b.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
), total as (
  select lang, cast(sum(len(w)) as bigint) as n from t group by lang
)
select ranked.lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from ranked join total on total.lang = ranked.lang where rank <= 2000
"""


QUERIES = {
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_decontam": op3_decontam,
    "op4_simhash": op4_simhash,
    "op5_nbsvm": op5_nbsvm,
    "op6_pseudolm": op6_pseudolm,
    "op7_packing": op7_packing,
    "op8_rules": op8_rules,
    "op9_warc": op9_warc,
    "op10_linededup": op10_linededup,
    "op11_align": op11_align,
    "op12_jaccard": op12_jaccard,
    "op13_collocations": op13_collocations,
}

ORACLES = {"op1_chat": OP1_SQL, "op9_warc": OP9_SQL, "op10_linededup": OP10_SQL, "op12_jaccard": OP12_SQL, "op13_collocations": OP13_SQL}
