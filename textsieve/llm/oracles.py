"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
with texts as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from texts
), keys as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key
  from lines
), repeated as (
  select key, max(doc_id) as keeper from keys
  where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select keys.*, keeper is not null and doc_id <> keeper as gone from keys left join repeated using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') as words from pieces
), starts as (
  select lang, words, unnest(range(1, len(words) + 1)) as i from split
), grams as (
  select lang, unnest(list_transform(range(0, least(5, len(words) - i + 1)), lambda k: words[i:i + k])) as gram from starts
), f as (
  select lang, array_to_string(gram, ' ') as phrase, len(gram) as k, count(*) as f from grams group by lang, gram
), totals as (
  select lang, sum(f)::bigint as n from f where k = 1 group by lang
), candidates as (
  select lang, phrase, string_split(phrase, ' ') as words, k, f as a from f where k > 1 and f >= 100
), inner_phrases as (
  select c.lang, array_to_string(c.words[i:j], ' ') as phrase, max(c.a) as longer
  from candidates c, range(1, 6) s(i), range(1, 6) e(j)
  where j > i and j <= c.k and j - i + 1 < c.k group by all
), kept as (
  select c.* from candidates c left join inner_phrases p on c.lang = p.lang and c.phrase = p.phrase
  where p.longer is null or 100 * p.longer < 100 * c.a
), cuts as (
  select c.lang, c.phrase, c.a, c.k, cut, array_to_string(c.words[1:cut], ' ') as first_part, array_to_string(c.words[cut + 1:], ' ') as rest
  from kept c, range(1, 5) r(cut) where cut < c.k
), scored as (
  select cuts.lang, cuts.phrase, a, cut, x.f as l, y.f as r, n,
    ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = first_part
  join f y on y.lang = cuts.lang and y.phrase = rest join totals on totals.lang = cuts.lang
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest qualify rank <= 2000
"""

#: CRC-32 byte by byte; near words by the texts that are left when one code point is taken out.
SPELLING = f"""
with recursive rounds as (
  select b, 0 as i, b::bigint as v from range(256) t(b)
  union all
  select b, i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from rounds where i < 8
), crc as (
  select list(v order by b) as t from rounds where i = 8
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents
), counted as (
  select doc_id, run, count(*) as c from runs group by all
), coded as (
  select run, c, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x)::bigint - 64] end)) as bytes
  from counted
), hashed as (
  select run, c, xor(4294967295, list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint)) as h
  from coded, crc
), noisy as (
  select case when h % 97 = 0 then run[1:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word, c from hashed
), words as (
  select word, sum(c)::bigint as n from noisy where length(word) >= 5 group by word having sum(c) >= 3
), cut as (
  select word, n, i, word[1:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), pairs as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select cut.word, words.word, words.n from cut join words on words.word = rest
  union select words.word, cut.word, cut.n from cut join words on words.word = rest
), near as (
  select word, count(*) as n_near, max(other_n) as m from pairs group by word
), best as (
  select pairs.word, n_near, m, min(other) as other from pairs join near on near.word = pairs.word and m = other_n group by all
), forms as (
  select words.word, n, coalesce(n_near, 0) as n_near,
    case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n
  from words left join best on best.word = words.word
), chain as (
  select word, word as at from forms
  union all
  select chain.word, forms.form from chain join forms on forms.word = chain.at where forms.form is not null
), roots as (
  select chain.word, chain.at as root from chain join forms on forms.word = chain.at where forms.form is null
)
select forms.word, form, root, n, n_near, form_n from forms join roots on roots.word = forms.word
"""
