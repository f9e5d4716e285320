"""DuckDB SQL for the queries that SQL can express."""

#: Words of a lower-cased text, in the pattern that the query's contract fixes.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CHAT = r"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), each as (
  select *, replace(replace(text, '\', '\\'), '<|', '<\|') as escaped from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from each group by conv_id
"""

DECONTAMINATION = f"""
with words as (select doc_id, {WORDS} as w from documents),
item_words as (select item_id, {WORDS} as w from benchmark),
item_windows as (
  select distinct item_id, least(8, len(w)) as k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as window_text
  from (select *, unnest(range(1, len(w) - least(8, len(w)) + 2)) as i from item_words where len(w) > 0)
), sizes as (select distinct k from item_windows),
doc_windows as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as window_text
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k)
), hits as (select doc_id, i, k, item_id from doc_windows join item_windows using (k, window_text)),
counted as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from hits)) group by doc_id
), found as (
  select doc_id, count(distinct item_id) as n_items, sha256(array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',')) as items from hits group by doc_id
)
select words.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items, sha256('')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words left join counted using (doc_id) left join found using (doc_id)
"""

ORACLE_SQL = {"op3_chat_format": CHAT, "op5_benchmark_decontamination": DECONTAMINATION}
