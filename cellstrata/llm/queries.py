"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellstrata.llm import bpe, decontaminate, extract, jaccard, licences, neighbours, pii, quality, repair, tokenfile, toxicity, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op1_near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2_byte_bpe(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4_warc(_table(spark, sf_dir, "pages"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op5_jaccard(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6_pii(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op7_licences(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8_decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.op10_html(_table(spark, sf_dir, "pages"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op11_repair(_table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op12_prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op13_token_files(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_jaccard": op5_jaccard,
    "op6_pii": op6_pii,
    "op7_licences": op7_licences,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_repair": op11_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}

def _licence_sql() -> str:
    """Every place of every key phrase, word after word, without the index."""
    templates = licences.parsed()
    listed = lambda rows: ", ".join(str(r) for r in rows)
    phrases = [(k, i, p) for k, t in enumerate(templates) for i, p in enumerate(t.phrases)]
    steps = listed((f, j, w.decode()) for f, (_, _, p) in enumerate(phrases) for j, w in enumerate(p.words))
    phrase = listed((f, k, i, len(p.words), p.gap, p.distance, p.slack) for f, (k, i, p) in enumerate(phrases))
    template = listed((k, t.label, len(t.phrases), len(t.distinct)) for k, t in enumerate(templates))
    members = listed((k, w.decode()) for k, t in enumerate(templates) for w in sorted(t.distinct))
    base = [(label, phrase.split()) for phrase, label in licences.BASE.items()]
    base_places = listed((k, q, w) for k, (_, ws) in enumerate(base) for q, w in enumerate(ws))
    base_meta = listed((k, label, len(ws)) for k, (label, ws) in enumerate(base))
    upper = "".join(map(chr, range(65, 91)))
    return f"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        steps(f, j, word) as (values {steps}),
        phrase(f, k, i, n, gap, distance, slack) as (values {phrase}),
        template(k, label, n_phrases, n_words) as (values {template}),
        member(k, word) as (values {members}),
        base_places(k, q, word) as (values {base_places}),
        base_meta(k, label, n) as (values {base_meta}),
        tok as (select * from (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from d) where word in (select word from member)),
        walk as (
            select doc_id, f, 0 as j, p as s, p as e from tok join steps using (word) where j = 0
            union
            select walk.doc_id, walk.f, walk.j + 1, walk.s, tok.p
            from walk join steps on steps.f = walk.f and steps.j = walk.j + 1 join phrase on phrase.f = walk.f
            join tok on tok.doc_id = walk.doc_id and tok.word = steps.word and tok.p between walk.e + 1 and walk.e + 1 + phrase.gap
        ),
        stands as (select distinct doc_id, f, k, i, s, n_phrases, distance, slack from walk join phrase using (f) join template using (k) where j = n - 1),
        begins as (select a.doc_id, a.k, a.s from stands a join stands b on a.doc_id = b.doc_id and a.k = b.k and abs(b.s - a.s - b.distance) <= b.slack
                   where a.i = 0 and (b.i > 0 or b.s = a.s) group by a.doc_id, a.k, a.s, a.n_phrases having count(distinct b.i) = a.n_phrases),
        held as (select doc_id, k, count(distinct word) as n from tok join member using (word) group by all),
        found as (select distinct doc_id, label, held.n / n_words::double as score from begins join held using (doc_id, k) join template using (k)),
        base_hits as (select doc_id, k, p - q as s, count(*) as same from tok join base_places using (word) where p >= q group by all),
        based as (select doc_id, label, s from base_hits join base_meta using (k) where same = n),
        b as (select doc_id, count(*) as n_base, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) as base_labels from based group by doc_id),
        l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from based union all select doc_id, label from found) group by doc_id),
        f as (select doc_id, max(score) as score from found group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from d left join b using (doc_id) left join l using (doc_id) left join f using (doc_id)
    """


def _components_sql(nodes: str, links: str) -> str:
    """CTEs after ``nodes(id)`` and ``links(a, b)``: ``comp(id, component_id)``, by paths from every node."""
    return f"""
        {nodes}, {links},
        ends as (select a, b from links union select b, a from links),
        reach(id, r) as (select id, id from nodes union select ends.b, reach.r from reach join ends on ends.a = reach.id),
        comp as (select id, min(r) as component_id from reach group by id)
    """


def _crc_sql(s: str) -> str:
    """Unsigned CRC-32 of the ASCII string ``s``, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, strlen({s}) + 1), lambda i: ord(substr({s}, i, 1))::bigint)), lambda c, b: {byte}), 4294967295)"


def _repair_sql() -> str:
    """Least (cost, initials) for each last role after each row; a least structure is the cheapest, then the ASCII-least."""
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    follow = {"n": "u", "s": "u", "u": "a", "a": "u"}  # n: no row kept yet

    def put(cost: str, edits: str, to: str) -> str:
        return f"case when {to} is not null then struct_pack(c := {to}.c + {cost}, e := {to}.e || {edits}) end"

    # one and two inserts before a row, from each state
    one = {q: [put("0", "''", f"w.{q}")] for q in follow}
    for q, then in follow.items():
        one[then].append(put("3", "'I'", f"w.{q}"))
        one[follow[then]].append(put("6", "'II'", f"w.{q}"))
    ready = {q: f"least({', '.join(x)})" for q, x in one.items()}
    stays, more = "k.fault in ('k', 't')", "(case when k.fault = 't' then 3 else 0 end)"
    after = {q: [put("4", "'D'", f"r.{q}")] for q in follow}
    for q, then in follow.items():
        after[then].append(f"case when {stays} then {put('3 + ' + more, chr(39) + 'R' + chr(39), 'r.' + q)} end")
        after[then].append(f"case when {stays} and k.initial = '{then}' then {put(more, chr(39) + 'K' + chr(39), 'r.' + q)} end")
    after["s"].append(f"case when {stays} and k.initial = 's' then {put(more, chr(39) + 'K' + chr(39), 'r.n')} end")
    state = ", ".join(f"least({', '.join(after[q])}) as {q}" for q in follow)
    end = "least(r.n, r.a)"
    nothing = "null::struct(c bigint, e varchar)"
    return f"""
        with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') as conv, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
        hashed as (select *, {_crc_sql('key')} % 20 as k from src),
        dealt as (select conv, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                  unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from hashed),
        named as (select *, sha256(length(role) || ':' || role || text) as print, rtrim(text, {white}) as ends from dealt),
        placed as (select *, row_number() over (partition by conv order by turn nulls first, print, copy) as i from named),
        k as (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial,
              case when ends = '' then 'b' when row_number() over (partition by conv, print order by i) > 1 then 'd' when right(ends, 1) in ('.', '!', '?') then 'k' else 't' end as fault from placed),
        walk(conv, i, n, s, u, a) as (
            select conv, 0::bigint, struct_pack(c := 0::bigint, e := ''), {nothing}, {nothing}, {nothing} from (select distinct conv from k)
            union all
            select conv, i, n, s, u, a from (
                select k.conv, k.i, {state} from k join (select w.conv, w.i, {", ".join(f"{x} as {q}" for q, x in ready.items())} from walk w) r on k.conv = r.conv and k.i = r.i + 1)),
        size as (select conv, count(*) as n_rows, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
                 case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps from k group by conv),
        bad as (select conv, count(*) filter (last || initial not in ('su', 'ua', 'au')) as illegal from (select conv, initial, lag(initial) over (partition by conv order by i) as last from k) where last is not null group by conv),
        best as (select r.conv, {end}.c as cost, {end}.e as audit from (select w.conv, w.i, {", ".join(f"{x} as {q}" for q, x in ready.items())} from walk w) r join size on size.conv = r.conv and size.n_rows = r.i),
        letters as (select conv, unnest(range(1, strlen(audit) + 1)) as p, audit from best),
        edits as (select conv, p, substr(audit, p, 1) as e, strlen(regexp_replace(left(audit, p), 'I', '', 'g')) as i from letters),
        done as (select edits.conv, p, e, k.role, coalesce(case when e <> 'I' then k.text end, '') as text, row_number() over (partition by edits.conv order by p) - max(case when e = 'K' and k.initial = 's' then 1 else 0 end) over (partition by edits.conv) as place
                 from edits left join k on k.conv = edits.conv and k.i = edits.i where e <> 'D'),
        lines as (select conv, p, (case when e = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end) || ':' || text as line from done),
        sha as (select conv, sha256(string_agg(line, chr(10) order by p)) as repaired_sha256 from lines group by conv)
        select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
               coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
        from (select distinct conv_id, conv from src) o left join size using (conv) left join bad using (conv) left join best using (conv) left join sha using (conv)
    """


_TRIE_SQL = f"""
    with src as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    own as (select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, sha256(length(role) || ':' || role || text)) as t, {_crc_sql('conv_id::varchar')} % 6 as h from src group by conv_id),
    whole as (select o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) as t from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
    prefix as (select conv_id, len(t) as n, d, t[1:d] as p from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from whole)),
    node as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d) as ends from prefix group by p, d),
    tree as (select node.*, above.conv_id as parent_conv_id, (select count(*) from node below where below.d = node.d + 1 and below.p[1:node.d] = node.p) as n_children
             from node left join node above on above.d = node.d - 1 and above.p = node.p[1:node.d - 1]),
    spread as (select p[1:k] as p, k as d, (n_children = 0)::bigint as leaf, case when d = 0 then 0 else (n_convs - 1) * length(p[d].text) end as saved from (select *, unnest(range(0, d + 1)) as k from tree)),
    total as (select p, d, sum(leaf) as n_leaves, sum(saved) as saved_tokens from spread group by p, d)
    select tree.conv_id, tree.d::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
    from tree join total using (p, d)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_near_vectors": "with recursive "
    + _components_sql(
        """nodes as (select vec_id as id from embeddings),
        usable as (select vec_id, label, embedding::double[] as v from embeddings
                   where label is not null and embedding is not null
                     and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
                     and len([x for x in embedding if x <> 0]) > 0)""",
        """links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
                  where list_cosine_similarity(a.v, b.v) >= 0.98::double)""",
    )
    + """
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from embeddings join comp on comp.id = vec_id
        left join (select a, count(*) as n from ends group by a) on a = vec_id
    """,
    "op5_jaccard": "with recursive "
    + _components_sql(
        """w as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                        else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
        nodes as (select doc_id as id from documents),
        tok as (select doc_id, len(s) as n, unnest(s) as t from sets)""",
        """links as (select x.doc_id as a, y.doc_id as b from tok x join tok y on x.t = y.t and x.doc_id < y.doc_id
                  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*)))""",
    )
    + """
        select doc_id, len(s)::bigint as n_shingles, component_id from sets join comp on comp.id = doc_id
    """,
    "op7_licences": _licence_sql(),
    "op11_repair": _repair_sql(),
    "op12_prefix_trie": _TRIE_SQL,
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest from p),
        m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from d)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < last then last end as refers_to
        from m
    """,
}
