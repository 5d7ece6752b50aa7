"""DuckDB twins of the registered queries (the correctness oracle).

Each function returns one SQL string over the pre-registered views.  The
draw arithmetic comes from ``lexiforge.functions.draws`` so both engines use
the same fixed constants; everything else is written out in SQL.
"""

from __future__ import annotations

from lexiforge.functions.draws import sql_hash64 as H
from lexiforge.functions.draws import sql_pick as PICK
from lexiforge.functions.draws import sql_uniform as U
from lexiforge.operators.eda import RD_FALLBACK_POS, RI_STRIDE, RS_STRIDE, SR_SYN_POS
from lexiforge.sources.corpus import sql_units


def units_cte(name: str = "units", table: str = "documents", key: str = "doc_id", label: str = "lang") -> str:
    return f"{name} AS {sql_units(table, key, 'text', label)}"


def stop_cte(top: int = 50) -> str:
    return f"""stop AS (
      SELECT w AS word FROM (SELECT unnest(list_distinct(tokens)) AS w FROM units)
      GROUP BY w ORDER BY count(*) DESC, w LIMIT {top})"""


def lexicon_ctes(k: int = 2, top: int = 5) -> str:
    leads = ", ".join([f"lead(word, {d}) OVER w AS a{d}" for d in range(1, k + 1)] +
                      [f"lag(word, {d}) OVER w AS b{d}" for d in range(1, k + 1)])
    cols = ", ".join([f"a{d}" for d in range(1, k + 1)] + [f"b{d}" for d in range(1, k + 1)])
    return f"""ctx AS (
      SELECT tokens[t.i + 1] AS word,
             CASE WHEN t.i > 0 THEN tokens[t.i] ELSE '<s>' END AS prev,
             CASE WHEN t.i + 1 < len(tokens) THEN tokens[t.i + 2] ELSE '</s>' END AS next
      FROM units, unnest(range(len(tokens))) AS t(i)),
    filled AS (SELECT prev, next, word, count(*) AS c FROM ctx GROUP BY prev, next, word),
    win AS (SELECT word, {leads} FROM filled WINDOW w AS (PARTITION BY prev, next ORDER BY c DESC, word)),
    pairs AS (SELECT word, unnest([{cols}]) AS synonym FROM win),
    scored AS (SELECT word, synonym, CAST(count(*) AS DOUBLE) AS score FROM pairs
               WHERE synonym IS NOT NULL GROUP BY word, synonym),
    lex AS (SELECT word, synonym, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, synonym) AS rank
            FROM scored QUALIFY rank <= {top})"""


def attach_ctes() -> str:
    return """lists AS (SELECT word, list(synonym ORDER BY rank) AS syns FROM lex GROUP BY word),
    ex AS (SELECT DISTINCT unit_key, unnest(tokens) AS word FROM units),
    ent AS (SELECT ex.unit_key, list(ex.word ORDER BY ex.word) AS ew, list(l.syns ORDER BY ex.word) AS es
            FROM ex JOIN lists l ON ex.word = l.word GROUP BY ex.unit_key),
    st AS (SELECT ex.unit_key, list(ex.word) AS stops FROM ex JOIN stop s ON ex.word = s.word GROUP BY ex.unit_key),
    ul AS (SELECT u.*, coalesce(ent.ew, []) AS ew, coalesce(ent.es, []) AS es, coalesce(st.stops, []) AS stops
           FROM units u LEFT JOIN ent ON u.unit_key = ent.unit_key LEFT JOIN st ON u.unit_key = st.unit_key)"""


def _has(w: str) -> str:
    return f"list_contains(ew, {w})"


def _syns(w: str) -> str:
    return f"es[list_position(ew, {w})]"


def _n(alpha: float) -> str:
    return f"greatest(1, CAST(floor({alpha} * len(tokens)) AS INTEGER))"


def sr_entries(h: str, alpha: float) -> str:
    """The words that E1 replaces and their synonyms: evaluated once per row, as a column of ``hx``."""
    d = "list_filter(tokens, lambda w, i: list_position(tokens, w) = i)"
    cands = (f"list_filter(list_transform({d}, lambda w, k: {{'d': {U(h, 'k - 1')}, 'w': w, 'k': k - 1}}), "
             f"lambda s: NOT list_contains(stops, s.w) AND {_has('s.w')})")
    chosen = f"list_sort({cands})[1:{_n(alpha)}]"
    return (f"list_transform({chosen}, lambda s: {{'w': s.w, 's': {_syns('s.w')}"
            f"[{PICK(h, f's.k + {SR_SYN_POS}', 'len(' + _syns('s.w') + ')')} + 1]}})")


def sr_columns(names: list[tuple[str, int]], alpha: float) -> str:
    """Columns _w_sr_v and _s_sr_v: words to replace and their synonyms, in one order."""
    cols = []
    for t, v in names:
        if t == "sr":
            cols += [f"{sr_entries(f'_h_sr_{v}', alpha)} AS _e_sr_{v}",
                     f"list_transform(_e_sr_{v}, lambda e: e.w) AS _w_sr_{v}",
                     f"list_transform(_e_sr_{v}, lambda e: e.s) AS _s_sr_{v}"]
    return ", ".join(cols)


def hashed_ctes(src: str, seed: int, names: list[tuple[str, int]], alpha: float) -> str:
    extra = sr_columns(names, alpha)
    return (f"hx0 AS (SELECT *, {hash_cols(seed, names)} FROM {src}),\n"
            f"hx AS (SELECT *{', ' + extra if extra else ''} FROM hx0)")


def sql_sr(h: str, alpha: float) -> str:
    w, s = h.replace("_h_", "_w_"), h.replace("_h_", "_s_")
    replaced = f"list_transform(tokens, lambda t: coalesce({s}[list_position({w}, t)], t))"
    return f"string_split(array_to_string({replaced}, ' '), ' ')"


def sql_ri(h: str, alpha: float) -> str:
    base = f"(s * {RI_STRIDE})"
    tries = [f"acc[{PICK(h, f'{base} + {t}', 'len(acc)')} + 1]" for t in range(4)]
    chosen = "CASE " + " ".join(f"WHEN {_has(t)} THEN {t}" for t in tries) + " END"
    syns = _syns(chosen)
    syn = f"{syns}[{PICK(h, f'{base} + 4', f'len({syns})')} + 1]"
    at = PICK(h, f"{base} + 5", "len(acc)")
    step = (f"CASE WHEN ({chosen}) IS NULL THEN acc "
            f"ELSE list_concat(acc[1:{at}], [{syn}], acc[{at} + 1:]) END")
    return f"list_reduce(range({_n(alpha)}), lambda acc, s: {step}, tokens)"


def sql_rs(h: str, alpha: float) -> str:
    base = f"(s * {RS_STRIDE})"
    L = "len(tokens)"
    raw = (f"list_transform(range({_n(alpha)}), lambda s: {{'i': {PICK(h, base, L)}, "
           f"'j1': {PICK(h, f'{base} + 1', L)}, 'j2': {PICK(h, f'{base} + 2', L)}, 'j3': {PICK(h, f'{base} + 3', L)}}})")
    pairs = (f"list_transform({raw}, lambda q: {{'i': q.i, 'j': CASE WHEN q.j1 <> q.i THEN q.j1 "
             f"WHEN q.j2 <> q.i THEN q.j2 WHEN q.j3 <> q.i THEN q.j3 ELSE q.i END}})")
    step = ("list_transform(acc, lambda w, k: CASE WHEN k - 1 = p.i THEN acc[p.j + 1] "
            "WHEN k - 1 = p.j THEN acc[p.i + 1] ELSE w END)")
    return f"list_reduce({pairs}, lambda acc, p: {step}, tokens)"


def sql_rd(h: str, p: float) -> str:
    kept = f"list_filter(tokens, lambda w, i: {U(h, 'i - 1')} > {p})"
    one = f"[tokens[{PICK(h, str(RD_FALLBACK_POS), 'len(tokens)')} + 1]]"
    return (f"CASE WHEN len(tokens) <= 1 THEN tokens WHEN len({kept}) = 0 THEN {one} ELSE {kept} END")


TECH_SQL = {"sr": sql_sr, "ri": sql_ri, "rs": sql_rs, "rd": sql_rd}


def hash_cols(seed: int, names: list[tuple[str, int]]) -> str:
    return ", ".join(f"{H(str(seed), repr(t), 'unit_key', str(v))} AS _h_{t}_{v}" for t, v in names)


def single_technique_sql(technique: str, n_variants: int = 3, alpha: float = 0.1, seed: int = 2020,
                         needs_lexicon: bool = False) -> str:
    src = "ul" if needs_lexicon else "units"
    ctes = [units_cte()]
    if needs_lexicon:
        ctes += [stop_cte(), lexicon_ctes(), attach_ctes()]
    ctes.append(hashed_ctes(src, seed, [(technique, v) for v in range(n_variants)], alpha))
    arr = ", ".join(f"array_to_string({TECH_SQL[technique](f'_h_{technique}_{v}', alpha)}, ' ')"
                    for v in range(n_variants))
    return ("WITH " + ",\n".join(ctes) + f"""
    SELECT doc_id, sent_no, chunk_no, label, CAST(t.v AS BIGINT) AS variant, [{arr}][t.v + 1] AS text
    FROM hx, unnest(range({n_variants})) AS t(v)""")


def eda_sql(alpha: float = 0.1, num_aug: int = 9, seed: int = 2020) -> str:
    nv = num_aug // 4 + 1
    names = [(t, v) for t in ("sr", "ri", "rs", "rd") for v in range(nv)]
    ctes = [units_cte(), stop_cte(), lexicon_ctes(), attach_ctes(),
            hashed_ctes("ul", seed, names + [("w1", 0)], alpha)]
    items = []
    for idx, (t, v) in enumerate(names):
        items.append(f"{{'d': {U('_h_w1_0', str(idx))}, 'idx': {idx}, 'method': '{t}', "
                     f"'text': array_to_string({TECH_SQL[t](f'_h_{t}_{v}', alpha)}, ' ')}}")
    orig = f"{{'d': 2.0, 'idx': {len(names)}, 'method': 'orig', 'text': array_to_string(tokens, ' ')}}"
    ctes.append(f"""va AS (SELECT doc_id, sent_no, chunk_no, label,
                 list_concat(list_sort([{', '.join(items)}])[1:{num_aug}], [{orig}]) AS vs FROM hx)""")
    return ("WITH " + ",\n".join(ctes) + """
    SELECT doc_id, sent_no, chunk_no, label, CAST(t.i AS BIGINT) AS aug_no, vs[t.i + 1].method AS method,
           vs[t.i + 1].text AS text
    FROM va, unnest(range(len(vs))) AS t(i)""")


def units_sql() -> str:
    return f"""WITH {units_cte()}
    SELECT doc_id, sent_no, chunk_no, label, CAST(len(tokens) AS BIGINT) AS n_tokens,
           array_to_string(tokens, ' ') AS text FROM units"""


def stop_words_sql() -> str:
    return f"WITH {units_cte()}, {stop_cte()} SELECT word FROM stop"


def synonyms_sql() -> str:
    return f"WITH {units_cte()}, {lexicon_ctes()} SELECT word, synonym, score, CAST(rank AS BIGINT) AS rank FROM lex"


ORACLES = {
    "p3_units": units_sql(),
    "j6_stop_words": stop_words_sql(),
    "e13_synonyms": synonyms_sql(),
    "e1_synonym_replace": single_technique_sql("sr", needs_lexicon=True),
    "e2_random_insert": single_technique_sql("ri", needs_lexicon=True),
    "e3_random_swap": single_technique_sql("rs"),
    "e4_random_delete": single_technique_sql("rd"),
    "e5_eda": eda_sql(),
}


# --- vocabulary and encoding -------------------------------------------------
RESERVED_VALUES = "(VALUES (0, '<_PAD>'), (1, '<_EOS>'), (2, '<_GO>'), (3, '<_UNK>'), (4, '<_OOD>')) r(id, token)"


def norm_label(col: str) -> str:
    return f"CASE WHEN contains(lower({col}), 'other') THEN 'other' ELSE lower({col}) END"


def vocab_ctes() -> str:
    return f"""counts AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM units)
               WHERE token NOT IN (SELECT token FROM {RESERVED_VALUES}) GROUP BY token),
    vocab AS (SELECT CAST(id AS BIGINT) AS id, token, CAST(0 AS BIGINT) AS cnt FROM {RESERVED_VALUES}
              UNION ALL
              SELECT row_number() OVER (ORDER BY cnt DESC, token) + 4 AS id, token, cnt FROM counts)"""


def label_vocab_cte(src: str, col: str) -> str:
    return f"""lcounts AS (SELECT {norm_label(col)} AS label, count(*) AS cnt FROM {src}
                WHERE {col} IS NOT NULL GROUP BY 1),
    lvocab AS (SELECT CAST(0 AS BIGINT) AS id, '<_UNK>' AS label, CAST(0 AS BIGINT) AS cnt
               UNION ALL SELECT row_number() OVER (ORDER BY cnt DESC, label) AS id, label, cnt FROM lcounts)"""


def encode_ctes(max_len: int = 100) -> str:
    return f"""{vocab_ctes()}, {label_vocab_cte('units', 'label')},
    wr AS (SELECT doc_id, sent_no, chunk_no, {norm_label('label')} AS label,
                  list_concat(['<_GO>'], tokens[1:{max_len - 2}], ['<_EOS>']) AS utt FROM units WHERE len(tokens) > 0),
    ex AS (SELECT doc_id, sent_no, chunk_no, label, t.i AS pos, utt[t.i + 1] AS token
           FROM wr, unnest(range(len(utt))) AS t(i)),
    ids AS (SELECT ex.*, coalesce(v.id, 3) AS tid FROM ex LEFT JOIN vocab v ON ex.token = v.token),
    rb AS (SELECT doc_id, sent_no, chunk_no, label, list(CAST(tid AS INTEGER) ORDER BY pos) AS utter
           FROM ids GROUP BY doc_id, sent_no, chunk_no, label),
    enc AS (SELECT row_number() OVER (ORDER BY doc_id, sent_no, chunk_no) - 1 AS id, doc_id, sent_no, chunk_no,
                   CAST(coalesce(l.id, 0) AS INTEGER) AS intent, CAST(len(utter) AS INTEGER) AS len, utter
            FROM rb LEFT JOIN lvocab l ON rb.label = l.label)"""


def decode_sql(where: str = "") -> str:
    return f"""WITH {units_cte()}, {encode_ctes()},
    dx AS (SELECT id, t.i AS pos, utter[t.i + 1] AS tid FROM enc, unnest(range(len(utter))) AS t(i) {where})
    SELECT dx.id, string_agg(v.token, ' ' ORDER BY dx.pos) AS text
    FROM dx JOIN vocab v ON dx.tid = v.id GROUP BY dx.id"""


ORACLES.update({
    "j6_content_words": f"""WITH {units_cte()}, {stop_cte()}
        SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM units) WHERE token NOT IN (SELECT word FROM stop) GROUP BY token""".replace(units_cte(), units_cte()),
    "a1_token_freq": f"""WITH {units_cte()} SELECT token, count(*) AS cnt
        FROM (SELECT unnest(tokens) AS token FROM units) GROUP BY token""",
    "a1_char_freq": """SELECT token, count(*) AS cnt FROM (
        SELECT unnest(list_filter(string_split(regexp_replace(text, '\\s', '', 'g'), ''), lambda c: c <> '')) AS token
        FROM conversations) GROUP BY token""",
    "a2_vocab": f"WITH {units_cte()}, {vocab_ctes()} SELECT id, token, cnt FROM vocab",
    "a3_label_vocab": f"WITH {label_vocab_cte('conversations', 'role')} SELECT id, label, cnt FROM lvocab",
    "a4_token_probs": f"""WITH {units_cte()}, {vocab_ctes()}
        SELECT id AS token_id, token, cnt, cnt / sum(cnt) OVER () AS prob,
               sum(cnt) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(cnt) OVER () AS cum_prob
        FROM vocab WHERE cnt > 0""",
    "j1_encode": f"""WITH {units_cte()}, {encode_ctes()}
        SELECT id, doc_id, sent_no, chunk_no, intent, len, array_to_string(utter, ' ') AS utter FROM enc""",
    "j2_decode": decode_sql(),
    "s13_inspect": f"""WITH {units_cte()}, {encode_ctes()},
    dx AS (SELECT id, intent, len, t.i AS pos, utter[t.i + 1] AS tid FROM enc, unnest(range(len(utter))) AS t(i)
           WHERE id <= 5)
    SELECT dx.id, dx.intent, dx.len, string_agg(v.token, ' ' ORDER BY dx.pos) AS text
    FROM dx JOIN vocab v ON dx.tid = v.id GROUP BY dx.id, dx.intent, dx.len""",
})


# --- noise, batching, sampling -------------------------------------------------
PROBS_CTE = """probs AS (SELECT id AS token_id, cnt,
                   sum(cnt) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cnt,
                   sum(cnt) OVER () AS total FROM vocab WHERE cnt > 0),
    tot AS (SELECT max(total) AS total FROM probs)"""


def noise_sql(rate: float = 0.1, seed: int = 530) -> str:
    return f"""WITH {units_cte()}, {encode_ctes()}, {PROBS_CTE},
    hx AS (SELECT id, intent, len, utter, {H(str(seed), "'noise'", 'id')} AS h FROM enc),
    nx AS (SELECT id, intent, len, t.i AS pos, utter[t.i + 1] AS tid, h FROM hx, unnest(range(len(utter))) AS t(i)),
    nz AS (SELECT nx.*, (pos < len - 1 AND {U('h', 'pos * 2')} < {rate}) AS noised,
                  CAST(floor({U('h', 'pos * 2 + 1')} * tot.total) AS BIGINT) AS r FROM nx, tot),
    dr AS (SELECT nz.id, nz.intent, nz.len, nz.pos, CASE WHEN nz.noised THEN p.token_id ELSE nz.tid END AS tid
           FROM nz LEFT JOIN probs p ON nz.noised AND nz.r >= p.cum_cnt - p.cnt AND nz.r < p.cum_cnt)
    SELECT id, intent, len, array_to_string(list(CAST(tid AS INTEGER) ORDER BY pos), ' ') AS utter
    FROM dr GROUP BY id, intent, len"""


def random_ood_sql(max_len: int = 20, seed: int = 530) -> str:
    return f"""WITH {units_cte()}, {encode_ctes()}, {PROBS_CTE},
    hx AS (SELECT id, {H(str(seed), "'ood'", 'id')} AS h FROM enc),
    ln AS (SELECT id, h, {PICK('h', '0', str(max_len - 1))} + 1 AS len FROM hx),
    nx AS (SELECT ln.id, ln.h, ln.len, t.i AS pos,
                  CAST(floor({U('h', 't.i + 1')} * tot.total) AS BIGINT) AS r
           FROM ln, tot, unnest(range(ln.len)) AS t(i)),
    dr AS (SELECT nx.id, nx.len, nx.pos, CASE WHEN nx.pos = nx.len - 1 THEN 1 ELSE p.token_id END AS tid
           FROM nx LEFT JOIN probs p ON nx.pos < nx.len - 1 AND nx.r >= p.cum_cnt - p.cnt AND nx.r < p.cum_cnt)
    SELECT id, -1 AS intent, len, array_to_string(list(CAST(tid AS INTEGER) ORDER BY pos), ' ') AS utter
    FROM dr GROUP BY id, len"""


def padded_sql(bs: int = 16) -> str:
    return f"""WITH {units_cte()}, {encode_ctes()},
    b AS (SELECT *, CAST(floor(id / {bs}) AS BIGINT) AS batch_id FROM enc),
    m AS (SELECT *, max(len) OVER (PARTITION BY batch_id) AS batch_len FROM b)
    SELECT batch_id, id, len, batch_len, array_to_string(list_resize(utter, batch_len, 0), ' ') AS utter FROM m"""


def length_sorted_sql(bs: int = 20) -> str:
    return f"""WITH {units_cte()}, {encode_ctes()},
    r AS (SELECT *, row_number() OVER (ORDER BY len, id) - 1 AS rk FROM enc),
    b AS (SELECT *, CAST(floor(rk / {bs}) AS BIGINT) AS batch_id FROM r),
    m AS (SELECT *, max(len) OVER (PARTITION BY batch_id) AS batch_len FROM b)
    SELECT batch_id, id, len, batch_len, array_to_string(list_resize(utter, batch_len, 0), ' ') AS utter FROM m"""


def split_sql(train: float = 0.8, dev: float = 0.1, seed: int = 2020) -> str:
    h = H(str(seed), "'split'", "doc_id")
    u = f"({h} / 1152921504606846976.0)"
    return f"""SELECT doc_id, lang, text, CASE WHEN {u} < {train!r} THEN 'train' WHEN {u} < {train + dev!r} THEN 'dev'
               ELSE 'test' END AS split FROM documents"""


def tiers_sql(sizes=(100, 500, 2000, 5000), seed: int = 2020) -> str:
    tier = "CASE " + " ".join(f"WHEN draw_rank < {s} THEN {s}" for s in sorted(sizes)) + " END"
    return f"""WITH {units_cte()},
    d AS (SELECT doc_id, sent_no, chunk_no, label, {H(str(seed), "'tier'", 'doc_id', 'sent_no', 'chunk_no')} AS dr
          FROM units),
    r AS (SELECT *, row_number() OVER (ORDER BY dr, doc_id, sent_no, chunk_no) - 1 AS draw_rank FROM d)
    SELECT doc_id, sent_no, chunk_no, label, draw_rank, CAST({tier} AS INTEGER) AS tier FROM r"""


# --- vectors -------------------------------------------------------------------

def beta_sql(alpha: float) -> str:
    if float(alpha).is_integer():
        return f"list_sort([{', '.join(U('h', str(i)) for i in range(2 * int(alpha) - 1))}])[{int(alpha)}]"
    u, v, u1, u2 = (f"greatest({U('h', str(i))}, pow(2::DOUBLE, -60))" for i in range(4))
    y = f"((1 + cos(2 * pi() * {v}) * sqrt(1 - pow({u}, 2.0::DOUBLE / (2 * {alpha}::DOUBLE + 1)))) / 2)"
    return f"(1 / (1 + exp(ln((1 - {y}) / {y}) + (ln({u2}) - ln({u1})) / {alpha}::DOUBLE)))"


def pairs_cte(bs: int = 20, rate: float = 0.5, alpha: float = 1, seed: int = 2020, table: str = "embeddings",
              key: str = "vec_id") -> str:
    lam = beta_sql(alpha)
    return f"""rk AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS r FROM {table}),
    bt AS (SELECT *, CAST(floor(r / {bs}) AS BIGINT) AS batch_id, CAST(r % {bs} AS INTEGER) AS pos FROM rk),
    bz AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS bsize FROM bt),
    bk AS (SELECT *, CAST(floor(bsize * {rate}) AS INTEGER) AS k FROM bz),
    pr AS (SELECT a.batch_id, a.pos AS i, a.{key} AS key0, b.{key} AS key1, a.label AS label0, b.label AS label1,
                  a.embedding AS x0, b.embedding AS x1, {H(str(seed), "'mixup'", 'a.batch_id', 'a.pos')} AS h
           FROM bk a JOIN bk b ON a.batch_id = b.batch_id AND b.pos = a.bsize - a.k + a.pos WHERE a.pos < a.k),
    pl AS (SELECT *, {lam} AS lam FROM pr)"""


def logits_cte() -> str:
    return "lg AS (SELECT vec_id, CAST(embedding[1:10] AS DOUBLE[]) AS logits, label AS target FROM embeddings)"


def ce(logits: str, target: str) -> str:
    m = f"list_max({logits})"
    return f"(-({logits}[{target} + 1] - ({m} + ln(list_sum(list_transform({logits}, lambda x: exp(x - {m})))))))"


def gauss_cte() -> str:
    return """ge AS (SELECT label, t.i AS dim, embedding[t.i + 1] AS x FROM embeddings, unnest(range(len(embedding))) AS t(i)),
    ga AS (SELECT label, dim, avg(x) AS mu, ln(greatest(var_pop(x), 1e-12)) AS logvar, count(*) AS n
           FROM ge GROUP BY label, dim)"""


def latent_sql(seed: int = 2020) -> str:
    u1 = f"(1.0 - {U('h', 'ga.dim * 2')})"
    u2 = U("h", "ga.dim * 2 + 1")
    z = f"ga.mu + exp(ga.logvar / 2.0) * (sqrt(-2.0 * ln({u1})) * cos(2.0 * {__import__('math').pi!r} * {u2}))"
    return f"""WITH {gauss_cte()},
    rw AS (SELECT vec_id AS key, label, {H(str(seed), "'latent'", 'vec_id')} AS h FROM embeddings)
    SELECT rw.key, rw.label, ga.dim, round({z}, 4) AS z FROM rw JOIN ga ON rw.label = ga.label"""


def growth_sql(num_aug: int = 9, seed: int = 2020) -> str:
    """Which variants are kept hangs on their draws alone, so no text is made."""
    nv = num_aug // 4 + 1
    items = ", ".join(f"{{'d': {U('h', str(k))}, 'idx': {k}, 'method': '{t}'}}"
                      for k, t in enumerate(t for t in ("sr", "ri", "rs", "rd") for _ in range(nv)))
    return f"""WITH {units_cte()},
    hx AS (SELECT label, {H(str(seed), "'w1'", 'unit_key', '0')} AS h FROM units),
    kept AS (SELECT label, unnest(list_concat(list_transform(list_sort([{items}])[1:{num_aug}], lambda v: v.method), ['orig'])) AS method FROM hx)
    SELECT label, method, count(*) AS n_rows FROM kept GROUP BY ROLLUP (label, method)"""


ORACLES.update({
    "e7_noise_tokens": noise_sql(),
    "e8_random_ood": random_ood_sql(),
    "w2_padded_batches": padded_sql(),
    "w3_length_sorted_batches": length_sorted_sql(),
    "l1_seeded_shuffle": f"""SELECT doc_id, lang, text, row_number() OVER (ORDER BY {H('2020', "'shuffle'", 'doc_id')}, doc_id) - 1 AS place
        FROM documents""",
    "l2_repeat_epochs": """SELECT conv_id, turn, role, text, CAST(e.epoch AS INTEGER) AS epoch
        FROM conversations, unnest(range(1, 4)) AS e(epoch)""",
    "l3_train_dev_test": split_sql(),
    "l4_leading_fraction": """SELECT conv_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= floor(count(*) OVER (PARTITION BY conv_id) * 0.5)""",
    "l5_low_resource_tiers": tiers_sql(),
    "e10_sentence_mixup": f"""WITH {pairs_cte()}
        SELECT batch_id, CAST(i AS BIGINT) AS i, key0, key1, round(lam, 6) AS lam, label0, label1, CAST(d.j AS BIGINT) AS dim,
               round(lam * x0[d.j + 1] + (1 - lam) * x1[d.j + 1], 6) AS value
        FROM pl, unnest(range(len(x0))) AS d(j)""",
    "e9_beta_draw": f"""WITH {pairs_cte(20, 0.3, 2)}
        SELECT batch_id, CAST(i AS BIGINT) AS i, key0, key1, round(lam, 6) AS lam FROM pl""",
    **{name: f"WITH {pairs_cte(20, 0.5, alpha)} SELECT batch_id, i, key0, key1, round(lam, 6) AS lam FROM pl"
       for name, alpha in (("e9_beta_draw_04", 0.4), ("e9_beta_draw_15", 1.5))},
    "a5_accuracy": f"""WITH {logits_cte()}
        SELECT count(*) AS n, sum(CAST(list_position(logits, list_max(logits)) - 1 = target AS INTEGER)) AS correct,
               round(avg(CAST(list_position(logits, list_max(logits)) - 1 = target AS INTEGER)), 6) AS accuracy,
               round(avg({ce('logits', 'target')}), 6) AS loss FROM lg""",
    "a7_mixup_loss": f"""WITH {logits_cte()}, {pairs_cte()},
        mx AS (SELECT lam, label0, label1,
                      list_transform(range(10), lambda j: lam * x0[j + 1] + (1 - lam) * x1[j + 1]) AS logits FROM pl),
        c AS (SELECT count(*) AS n_clean, avg({ce('logits', 'target')}) AS clean_loss FROM lg),
        m AS (SELECT count(*) AS n_mixed,
                     avg(lam * {ce('logits', 'label0')} + (1 - lam) * {ce('logits', 'label1')}) AS mix_loss FROM mx)
        SELECT n_clean, n_mixed, round(clean_loss, 6) AS clean_loss, round(mix_loss, 6) AS mix_loss,
               round(clean_loss + coalesce(mix_loss, 0), 6) AS total_loss FROM c, m""",
    "a14_label_gaussians": f"""WITH {gauss_cte()}
        SELECT label, dim, round(mu, 6) AS mu, round(logvar, 6) AS logvar, n FROM ga""",
    "a15_kl_divergence": f"""WITH {gauss_cte()},
        po AS (SELECT dim, avg(x) AS mu0, ln(greatest(var_pop(x), 1e-12)) AS logvar0 FROM ge GROUP BY dim)
        SELECT label, round(0.5 * sum(exp(logvar - logvar0) + (mu - mu0) ^ 2 / exp(logvar0) - 1 - (logvar - logvar0)), 5) AS kl
        FROM ga JOIN po ON ga.dim = po.dim GROUP BY label""",
    "e15_latent_sample": latent_sql(),
    "a10_corpus_stats": f"""WITH {units_cte()}
        SELECT 'n_units' AS metric, count(*) AS value FROM units
        UNION ALL SELECT 'n_tokens', sum(len(tokens)) FROM units
        UNION ALL SELECT 'vocab_size', count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM units)
        UNION ALL SELECT 'n_labels', count(DISTINCT label) FROM units""",
    "a12_growth_report": growth_sql(),
})


# --- generation and collection ---------------------------------------------------
TRANS_CTE = """pz AS (SELECT label, list_concat(['<_GO>'], tokens) AS ip, list_concat(tokens, ['<_EOS>']) AS tg FROM units),
    pp AS (SELECT label, ip[t.i + 1] AS prev, tg[t.i + 1] AS next FROM pz, unnest(range(len(ip))) AS t(i)),
    tc AS (SELECT label, prev, next, count(*) AS cnt FROM pp GROUP BY label, prev, next),
    tt AS (SELECT label, prev, sum(cnt) AS total FROM tc GROUP BY label, prev),
    trans AS (SELECT tc.label, tc.prev, tc.next, tc.cnt, tt.total, tc.cnt / tt.total AS p
              FROM tc JOIN tt ON tc.label = tt.label AND tc.prev = tt.prev)"""


MAX_DECODE_LEN = 80


def greedy_ctes(max_len: int = MAX_DECODE_LEN) -> str:
    return f"""{TRANS_CTE},
    best AS (SELECT label, prev, next FROM trans QUALIFY row_number() OVER (PARTITION BY label, prev ORDER BY cnt DESC, next) = 1),
    st AS (SELECT DISTINCT label, tokens[1] AS start FROM units),
    gen AS (
      WITH RECURSIVE g(label, start, seq, done, step) AS (
        SELECT label, start, [start], false, 0 FROM st
        UNION ALL
        SELECT g.label, g.start, CASE WHEN b.next IS NULL THEN g.seq ELSE list_append(g.seq, b.next) END,
               b.next IS NULL OR b.next = '<_EOS>', g.step + 1
        FROM g LEFT JOIN best b ON b.label = g.label AND b.prev = g.seq[len(g.seq)]
        WHERE NOT g.done AND g.step < {max_len})
      SELECT label, start, seq FROM g WHERE done OR step = {max_len})"""


def beam_sql(trans: str = "trans", extra: str = "", width: int = 5, max_len: int = MAX_DECODE_LEN) -> str:
    """All hypotheses of a source move on together until none is open."""
    return f"""WITH {units_cte()}, {TRANS_CTE}{extra},
    cand AS (SELECT label, prev, next, ln(p) AS lp FROM {trans}
             QUALIFY row_number() OVER (PARTITION BY label, prev ORDER BY cnt DESC, next) <= {width}),
    st AS (SELECT DISTINCT label, tokens[1] AS start FROM units),
    gen AS (
      WITH RECURSIVE g(label, start, seq, logp, done, step, active) AS (
        SELECT label, start, [start], CAST(0 AS DOUBLE), false, 0, true FROM st
        UNION ALL
        SELECT label, start, seq, logp, done, step, bool_or(NOT done) OVER (PARTITION BY label, start) AS active FROM (
          SELECT label, start, seq, logp, done, step FROM (
            SELECT g.label, g.start, CASE WHEN c.next IS NULL THEN g.seq ELSE list_append(g.seq, c.next) END AS seq,
                   g.logp + coalesce(c.lp, 0) AS logp, g.done OR c.next IS NULL OR c.next = '<_EOS>' AS done, g.step + 1 AS step
            FROM g LEFT JOIN cand c ON c.label = g.label AND c.prev = g.seq[len(g.seq)] AND NOT g.done
            WHERE g.active AND g.step < {max_len})
          QUALIFY row_number() OVER (PARTITION BY label, start ORDER BY round(logp, 9) DESC, array_to_string(seq, ' ')) <= {width}))
      SELECT label, start, seq, round(logp, 9) AS score FROM g WHERE NOT active OR step = {max_len})
    SELECT label, start, row_number() OVER (PARTITION BY label, start ORDER BY score DESC, array_to_string(seq, ' ')) AS rank,
           array_to_string(seq, ' ') AS seq, score, seq[len(seq)] = '<_EOS>' AS finished FROM gen"""


TOPK_CTES = """,
    kth AS (SELECT label, prev, avg(p) AS kth FROM (
              SELECT * FROM trans QUALIFY row_number() OVER (PARTITION BY label, prev ORDER BY cnt DESC, next) <= 5) GROUP BY label, prev),
    kept AS (SELECT t.label, t.prev, t.next, t.cnt, t.p FROM trans t JOIN kth k ON t.label = k.label AND t.prev = k.prev WHERE t.p >= k.kth),
    ktot AS (SELECT label, prev, sum(p) AS kp FROM kept GROUP BY label, prev),
    ftrans AS (SELECT kept.label, kept.prev, kept.next, kept.cnt, kept.p / ktot.kp AS p
               FROM kept JOIN ktot ON kept.label = ktot.label AND kept.prev = ktot.prev)"""


ORACLES.update({
    "g1_fit_transitions": f"WITH {units_cte()}, {TRANS_CTE} SELECT label, prev, next, cnt, total, round(p, 9) AS p FROM trans",
    "g2a_generate_greedy": f"""WITH {units_cte()}, {greedy_ctes()}
        SELECT label, start, array_to_string(seq, ' ') AS seq, seq[len(seq)] = '<_EOS>' AS finished FROM gen""",
    "g2b_generate_beam": beam_sql(),
    "g2c_generate_beam_topk": beam_sql("ftrans", TOPK_CTES),
    "g3_score_text": f"""WITH {units_cte()}, {TRANS_CTE},
        v AS (SELECT count(DISTINCT next) + 1 AS v FROM trans),
        rp AS (SELECT doc_id, sent_no, chunk_no, label, list_concat(['<_GO>'], tokens) AS ip,
                      list_concat(tokens, ['<_EOS>']) AS tg FROM units),
        rx AS (SELECT doc_id, sent_no, chunk_no, label, ip[t.i + 1] AS prev, tg[t.i + 1] AS next
               FROM rp, unnest(range(len(ip))) AS t(i))
        SELECT rx.doc_id, rx.sent_no, rx.chunk_no, rx.label,
               round(sum(-ln((coalesce(tr.cnt, 0) + 1) / (coalesce(tt.total, 0) + v.v))), 6) AS nll, count(*) AS n_tok
        FROM rx LEFT JOIN trans tr ON rx.label = tr.label AND rx.prev = tr.prev AND rx.next = tr.next
        LEFT JOIN tt ON rx.label = tt.label AND rx.prev = tt.prev, v
        GROUP BY rx.doc_id, rx.sent_no, rx.chunk_no, rx.label""",
    "a8_perplexity": f"""WITH {units_cte().replace('units AS', 'all_units AS', 1)},
        sp AS (SELECT *, {H('2020', "'split'", 'doc_id')} / 1152921504606846976.0 AS u FROM all_units),
        units AS (SELECT * FROM sp WHERE u < 0.8), held AS (SELECT * FROM sp WHERE u >= 0.8), {TRANS_CTE},
        v AS (SELECT count(DISTINCT next) + 1 AS v FROM trans),
        rp AS (SELECT doc_id, sent_no, chunk_no, label, list_concat(['<_GO>'], tokens) AS ip,
                      list_concat(tokens, ['<_EOS>']) AS tg FROM held),
        rx AS (SELECT doc_id, sent_no, chunk_no, label, ip[t.i + 1] AS prev, tg[t.i + 1] AS next
               FROM rp, unnest(range(len(ip))) AS t(i)),
        sc AS (SELECT rx.doc_id, rx.sent_no, rx.chunk_no, sum(-ln((coalesce(tr.cnt, 0) + 1) / (coalesce(tt.total, 0) + v.v))) AS nll,
                      count(*) AS n_tok
               FROM rx LEFT JOIN trans tr ON rx.label = tr.label AND rx.prev = tr.prev AND rx.next = tr.next
               LEFT JOIN tt ON rx.label = tt.label AND rx.prev = tt.prev, v
               GROUP BY rx.doc_id, rx.sent_no, rx.chunk_no)
        SELECT count(*) AS n_utt, sum(n_tok) AS n_tok, round(sum(nll) / sum(n_tok), 6) AS token_nll,
               round(exp(sum(nll) / sum(n_tok)), 6) AS ppl, round(sum(nll) / count(*), 6) AS utt_nll FROM sc""",
    "e12_collect_generated": f"""WITH {units_cte()}, {greedy_ctes()},
        rows AS (SELECT label, tokens[1] AS start, array_to_string(tokens, ' ') AS org FROM units),
        dec AS (SELECT label, start, array_to_string(CASE WHEN list_position(seq, '<_EOS>') > 0
                   THEN seq[1:list_position(seq, '<_EOS>') - 1] ELSE seq END, ' ') AS aug FROM gen),
        cand AS (SELECT r.org, d.aug, 'greedy' AS method, r.label FROM rows r JOIN dec d ON r.label = d.label AND r.start = d.start),
        nov AS (SELECT * FROM cand WHERE aug NOT IN (SELECT array_to_string(tokens, ' ') FROM units)),
        firsts AS (SELECT aug, arg_min(org, org) AS org, arg_min(label, org) AS label, arg_min(method, org) AS method
                   FROM (SELECT * FROM nov QUALIFY row_number() OVER (PARTITION BY aug ORDER BY org, label, method) = 1)
                   GROUP BY aug),
        cl AS (SELECT label, method, replace(org, ' ', '') AS org, replace(aug, ' ', '') AS aug,
                      list_filter(string_split(replace(replace(aug, ' ', ''), '<_UNK>', ''), ''), lambda c: c <> '') AS ch FROM firsts)
        SELECT label, array_to_string(list_filter(ch, lambda c, i: i = 1 OR c <> ch[i - 1]), '') AS text, method, org, aug
        FROM cl WHERE len(list_filter(ch, lambda c, i: i = 1 OR c <> ch[i - 1])) > 0""",
})


def all_candidates_ctes() -> str:
    """nov: the novel candidates (org, aug, method, m, label, text) of all three decoders, every hypothesis of a beam."""
    return f"""{units_cte()}, {greedy_ctes()},
        bm AS ({beam_sql()}), bk AS ({beam_sql("ftrans", TOPK_CTES)}),
        seqs AS (SELECT label, start, 'greedy' AS method, 0 AS m, seq FROM gen
                 UNION ALL SELECT label, start, 'beam', 1, string_split(seq, ' ') FROM bm
                 UNION ALL SELECT label, start, 'beam_topK', 2, string_split(seq, ' ') FROM bk),
        dec AS (SELECT label, start, method, m, array_to_string(CASE WHEN list_position(seq, '<_EOS>') > 0
                   THEN seq[1:list_position(seq, '<_EOS>') - 1] ELSE seq END, ' ') AS aug FROM seqs),
        rows AS (SELECT label, tokens[1] AS start, array_to_string(tokens, ' ') AS org FROM units),
        ch AS (SELECT r.org, d.aug, d.method, d.m, r.label,
                      list_filter(string_split(replace(replace(d.aug, ' ', ''), '<_UNK>', ''), ''), lambda c: c <> '') AS ch
               FROM rows r JOIN dec d ON r.label = d.label AND r.start = d.start
               WHERE d.aug NOT IN (SELECT array_to_string(tokens, ' ') FROM units)),
        nov AS (SELECT org, aug, method, m, label, array_to_string(list_filter(ch, lambda c, i: i = 1 OR c <> ch[i - 1]), '') AS text FROM ch)"""


ORACLES.update({
    "e12_collect_all_methods": f"""WITH {all_candidates_ctes()},
        firsts AS (SELECT * FROM nov QUALIFY row_number() OVER (PARTITION BY aug ORDER BY m, org, label) = 1)
        SELECT label, text, method, replace(org, ' ', '') AS org, replace(aug, ' ', '') AS aug FROM firsts WHERE text <> ''""",
    "e12_labelled_texts": f"WITH {all_candidates_ctes()} SELECT label, text FROM nov WHERE text <> ''",
})


# --- pivot paraphrase ------------------------------------------------------------
PARA_CTES = """wc AS (SELECT label AS lang, w AS word, count(*) AS cnt FROM (SELECT label, unnest(tokens) AS w FROM units)
            GROUP BY label, w),
    wr AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) - 1 AS rank FROM wc),
    fwd AS (SELECT a.lang AS src_lang, b.lang AS pivot_lang, a.word AS src, b.word AS dst, CAST(0.7 AS DOUBLE) AS p
            FROM wr a JOIN wr b ON b.rank = a.rank AND a.lang <> b.lang
            UNION ALL
            SELECT a.lang, b.lang, a.word, b.word, CAST(0.3 AS DOUBLE) FROM wr a JOIN wr b ON b.rank - 1 = a.rank AND a.lang <> b.lang),
    bck AS (SELECT a.lang AS pivot_lang, b.lang AS src_lang, a.word AS src, b.word AS dst, CAST(0.6 AS DOUBLE) AS p
            FROM wr a JOIN wr b ON b.rank = a.rank AND a.lang <> b.lang
            UNION ALL
            SELECT a.lang, b.lang, a.word, b.word, CAST(0.4 AS DOUBLE) FROM wr a JOIN wr b ON b.rank + 1 = a.rank AND a.lang <> b.lang),
    para AS (SELECT f.src_lang, f.pivot_lang, f.src AS e1, k.dst AS e2, sum(f.p * k.p) AS p
             FROM fwd f JOIN bck k ON f.src_lang = k.src_lang AND f.pivot_lang = k.pivot_lang AND f.dst = k.src
             WHERE f.src <> k.dst GROUP BY f.src_lang, f.pivot_lang, f.src, k.dst),
    best AS (SELECT src_lang, pivot_lang, e1 AS src, e2 AS best, p FROM para
             QUALIFY row_number() OVER (PARTITION BY src_lang, pivot_lang, e1 ORDER BY round(-p, 12), e2) = 1)"""

ORACLES.update({
    "j8_paraphrase_table": f"WITH {units_cte()}, {PARA_CTES} SELECT src_lang, pivot_lang, src, best, round(p, 9) AS p FROM best",
    "e6_pivot_paraphrase": f"""WITH {units_cte()}, {PARA_CTES},
        ux AS (SELECT doc_id, sent_no, chunk_no, label, t.i AS pos, tokens[t.i + 1] AS token
               FROM units, unnest(range(len(tokens))) AS t(i)),
        hit AS (SELECT ux.*, b.pivot_lang, b.best FROM ux JOIN best b ON b.src_lang = ux.label AND b.src = ux.token),
        pv AS (SELECT DISTINCT doc_id, sent_no, chunk_no, label, pivot_lang FROM hit),
        allp AS (SELECT pv.doc_id, pv.sent_no, pv.chunk_no, pv.label, pv.pivot_lang, ux.pos, coalesce(h.best, ux.token) AS tok
                 FROM pv JOIN ux ON pv.doc_id = ux.doc_id AND pv.sent_no = ux.sent_no AND pv.chunk_no = ux.chunk_no
                 LEFT JOIN hit h ON h.doc_id = ux.doc_id AND h.sent_no = ux.sent_no AND h.chunk_no = ux.chunk_no
                   AND h.pos = ux.pos AND h.pivot_lang = pv.pivot_lang)
        SELECT doc_id, sent_no, chunk_no, label, CAST(NULL AS VARCHAR) AS pivot_lang, array_to_string(tokens, ' ') AS text FROM units
        UNION ALL
        SELECT doc_id, sent_no, chunk_no, label, pivot_lang, string_agg(tok, ' ' ORDER BY pos) AS text
        FROM allp GROUP BY doc_id, sent_no, chunk_no, label, pivot_lang""",
})

ORACLES.update({
    "s11_tagged_rows": """SELECT 'root' AS domain, role AS label,
        array_to_string(list_filter(string_split(text, ''), lambda c: c <> ''), ' ') AS text FROM conversations""",
})


# --- preprocessing, union of methods ------------------------------------------------
def _pivot_rows_sql() -> str:
    s = ORACLES["e6_pivot_paraphrase"]
    return s


ORACLES.update({
    "p12_preprocess": f"""WITH {units_cte()}, {vocab_ctes()}, {label_vocab_cte('units', 'label')},
        px AS (SELECT doc_id, sent_no, chunk_no, {norm_label('label')} AS label, t.i AS pos,
                      list_concat(tokens, ['<_EOS>'])[t.i + 1] AS token
               FROM units, unnest(range(len(tokens) + 1)) AS t(i)),
        pi AS (SELECT px.*, coalesce(v.id, 3) AS tid FROM px LEFT JOIN vocab v ON px.token = v.token),
        pr AS (SELECT doc_id, sent_no, chunk_no, label, list(CAST(tid AS INTEGER) ORDER BY pos) AS utt
               FROM pi GROUP BY doc_id, sent_no, chunk_no, label)
        SELECT doc_id, sent_no, chunk_no, CAST(coalesce(l.id, -1) AS INTEGER) AS intent, array_to_string(utt, ' ') AS utt
        FROM pr LEFT JOIN lvocab l ON pr.label = l.label""",
    "u2_union_methods": f"""WITH ed AS ({eda_sql()}), pv AS ({_pivot_rows_sql()})
        SELECT doc_id, sent_no, chunk_no, label, method, text FROM ed
        UNION ALL
        SELECT doc_id, sent_no, chunk_no, label, 'pivot_' || pivot_lang AS method, text FROM pv WHERE pivot_lang IS NOT NULL""",
})


# --- word vectors ---------------------------------------------------------------------
def vector_ctes(dim: int = 32, min_links: int = 10, seed: int = 2020) -> str:
    sums = ", ".join(f"CAST(sum(CASE WHEN ((h >> {d}) & 1) = 1 THEN c ELSE -c END) AS DOUBLE)" for d in range(dim))
    return f"""nb AS (SELECT tokens[t.i] AS word, tokens[t.i + 1] AS near FROM units, unnest(range(1, len(tokens))) AS t(i)
            UNION ALL SELECT tokens[t.i + 1], tokens[t.i] FROM units, unnest(range(1, len(tokens))) AS t(i)),
    nc AS (SELECT word, near, count(*) AS c FROM nb GROUP BY word, near),
    nh AS (SELECT word, c, {H(str(seed), "'sign'", 'near', '0')} AS h FROM nc),
    rw AS (SELECT word, CAST(sum(c) AS BIGINT) AS links, [{sums}] AS raw FROM nh GROUP BY word HAVING sum(c) >= {min_links}),
    rn AS (SELECT *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS norm FROM rw),
    vec AS (SELECT word, links, list_transform(raw, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END) AS vector FROM rn)"""


UNIT_VECTORS = """wx AS (SELECT unit_key, doc_id, sent_no, label, t.i AS pos, tokens[t.i + 1] AS word
           FROM units, unnest(range(len(tokens))) AS t(i)),
    mx AS (SELECT wx.unit_key, wx.doc_id, wx.sent_no, wx.label, count(*) AS n_tokens, count(vec.vector) AS n_covered,
                  list(coalesce(vec.vector, list_transform(range(32), lambda d: 0.0::DOUBLE)) ORDER BY pos) AS embedding
           FROM wx LEFT JOIN vec ON wx.word = vec.word GROUP BY wx.unit_key, wx.doc_id, wx.sent_no, wx.label)"""


def scaled(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: CAST(floor(x * 10000 + 0.5) AS BIGINT)), ' ')"


ORACLES.update({
    "e13b_word_vectors": f"WITH {units_cte()}, {vector_ctes()} SELECT word, links, {scaled('vector')} AS vector FROM vec",
    "j5_unit_vectors": f"""WITH {units_cte()}, {vector_ctes()}, {UNIT_VECTORS},
        mn AS (SELECT *, list_transform(range(32), lambda d: list_sum(list_transform(embedding, lambda v: v[d + 1])) / len(embedding))
                         AS mean FROM mx)
        SELECT doc_id, sent_no, n_tokens, n_covered, {scaled('mean')} AS mean FROM mn""",
    "e11_word_mixup": f"""WITH {units_cte()}, {vector_ctes()}, {UNIT_VECTORS}, {pairs_cte(table='mx', key='unit_key')},
        px AS (SELECT pl.*, t.p AS pos, list_transform(range(1, 33), lambda d: lam * coalesce(x0[t.p + 1][d], 0.0)
                      + (1 - lam) * coalesce(x1[t.p + 1][d], 0.0)) AS mixed
               FROM pl, unnest(range(greatest(len(x0), len(x1)))) AS t(p))
        SELECT batch_id, i, key0, key1, round(lam, 6) AS lam, label0, label1, pos, {scaled('mixed')} AS mixed FROM px""",
    "a10_vector_coverage": f"""WITH {units_cte()}, {vector_ctes()},
        tc AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(tokens) AS w FROM units) GROUP BY w),
        tv AS (SELECT tc.*, vec.word IS NOT NULL AS has FROM tc LEFT JOIN vec ON tc.word = vec.word)
        SELECT 'n_words' AS metric, count(*) AS value FROM tv
        UNION ALL SELECT 'n_words_covered', count_if(has) FROM tv
        UNION ALL SELECT 'n_tokens', CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM tv
        UNION ALL SELECT 'n_tokens_covered', CAST(coalesce(sum(cnt) FILTER (has), 0) AS BIGINT) FROM tv""",
})


def stratified_sql(sizes=(100, 500, 2000, 5000), seed: int = 2020) -> str:
    tier = "CASE " + " ".join(f"WHEN position < {s} THEN {s}" for s in sorted(sizes)) + " END"
    return f"""WITH {units_cte()},
    d AS (SELECT doc_id, sent_no, label, array_to_string(tokens, ' ') AS text, {H(str(seed), "'tier'", 'doc_id', 'sent_no')} AS dr
          FROM units),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dr, doc_id, sent_no) - 1 AS label_rank,
                 count(*) OVER (PARTITION BY label) AS n FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY (2 * label_rank + 1)::DOUBLE / (2 * n), dr, doc_id, sent_no) - 1 AS position FROM r)
    SELECT doc_id, sent_no, label, text, label_rank, position, CAST({tier} AS BIGINT) AS tier FROM p
    WHERE position < {max(sizes)}"""


ORACLES["l5_stratified_tiers"] = stratified_sql()


# --- slots and streams -----------------------------------------------------------------
ORACLES.update({
    "p12_preprocess_slots": f"""WITH base AS ({ORACLES["p12_preprocess"]}), {units_cte()},
        sk AS (SELECT doc_id, sent_no, chunk_no, unnest(list_distinct(list_filter(list_transform(tokens, lambda w:
                      CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'number' WHEN regexp_matches(w, '[0-9]') THEN 'code'
                           WHEN length(w) = 1 THEN 'initial' END), lambda k: k IS NOT NULL))) AS slot FROM units),
        sv AS (SELECT slot, row_number() OVER (ORDER BY count(*) DESC, slot) - 1 AS id FROM sk GROUP BY slot),
        sr AS (SELECT doc_id, sent_no, chunk_no, list(id) AS ids FROM sk JOIN sv USING (slot) GROUP BY ALL)
        SELECT base.*, array_to_string(list_transform(range((SELECT count(*) FROM sv)), lambda k:
                   CASE WHEN list_contains(coalesce(ids, []), k) THEN 1 ELSE 0 END), ' ') AS slots
        FROM base LEFT JOIN sr USING (doc_id, sent_no, chunk_no)""",
    "x1_stream_eda": ORACLES["e5_eda"],
    "x1_stream_texts": f"SELECT DISTINCT label, text FROM ({ORACLES['e4_random_delete']})",
})
