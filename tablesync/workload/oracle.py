"""SQL twins of the registered queries for DuckDB, over the same tables."""

from __future__ import annotations

REPLICATION = """
src as (select * from orders where o_orderkey % 10 <> 7),
dst as (select o_orderkey, o_custkey, o_orderstatus,
  case when o_orderkey % 10 = 5 then o_totalprice - 1 else o_totalprice end as o_totalprice,
  o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 3),
ops as (
  select o_orderkey, 0 as ph, 2 as op, o_totalprice as price from orders where o_orderkey % 10 = 3
  union all select o_orderkey, 1, 3, o_totalprice from orders where o_orderkey % 20 = 3
  union all select o_orderkey, 1, 4, o_totalprice from orders where o_orderkey % 20 = 3
  union all select o_orderkey, 0, 3, o_totalprice - 1 from orders where o_orderkey % 10 = 5
  union all select o_orderkey, 0, 4, o_totalprice from orders where o_orderkey % 10 = 5
  union all select o_orderkey, 0, 3, o_totalprice from orders where o_orderkey % 20 = 7
  union all select o_orderkey, 0, 4, o_totalprice + 1 from orders where o_orderkey % 20 = 7
  union all select o_orderkey, 1, 1, o_totalprice + case when o_orderkey % 20 = 7 then 1 else 0 end
    from orders where o_orderkey % 10 = 7),
chg as (
  select lower(lpad(hex(cast(floor(p.o_orderkey / 100) as bigint) * 2 + ph + 1), 20, '0')) as start_lsn,
    lower(lpad(hex(p.o_orderkey * 2 + ph), 20, '0')) as seqval, op as operation,
    p.o_orderkey, o.o_custkey, o.o_orderstatus, p.price as o_totalprice, o.o_orderdate, o.o_orderpriority
  from ops p join orders o on p.o_orderkey = o.o_orderkey),
mid as (select lower(lpad(hex(cast(floor(max(o_orderkey) / 100) as bigint)), 20, '0')) as from_lsn from orders),
later as (select * from chg where start_lsn > (select from_lsn from mid)),
k as (select distinct o_orderkey from chg),
kh as (select distinct o_orderkey from later)
"""

CONTROL = """
flows as (select cast(s_suppkey + 1 as int) as flow_id, s_name as flow_name,
  'src-' || s_suppkey as source_server, 1433 as source_port, 'dst-' || s_suppkey as dest_server, 1433 as dest_port,
  s_suppkey % 5 <> 4 as is_enabled from supplier),
mappings as (select cast(c_custkey + 1 as int) as mapping_id, cast(c_custkey % 120 + 1 as int) as flow_id,
  'srcdb' as source_database, 'dbo' as source_schema, c_name as source_table,
  'dstdb' as dest_database, 'dbo' as dest_schema, c_name || '_copy' as dest_table, 'id' as primary_key_column,
  c_custkey % 7 = 0 as is_full_sync, c_custkey % 6 <> 5 as is_enabled, c_custkey % 2 = 0 as cdc_enabled,
  case when c_custkey % 3 = 0 then null else lower(lpad(hex(c_custkey * 16), 20, '0')) end as last_cdc_lsn from customer),
enabled as (select m.*, f.flow_name, f.source_server, f.source_port, f.dest_server, f.dest_port
  from mappings m join flows f on m.flow_id = f.flow_id where m.is_enabled and f.is_enabled),
logs as (select event_id as log_id,
  cast(case when event_id % 11 = 0 then null when event_id % 2 = 0 then user_id % 120 + 1
    else (event_id * 7) % 2000 % 120 + 1 end as int) as flow_id,
  cast(case when event_id % 13 = 0 then null when event_id % 3 = 0 then 1
    else (event_id * 7) % 2000 + 1 end as int) as mapping_id,
  case cast(event_id % 5 as int) when 0 then 'SYNC' when 1 then 'CONNECTION' when 2 then 'FULL_SYNC'
    when 3 then 'CDC' else 'VERIFICATION' end as log_type,
  concat('event ', event_type) as log_message,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'FAILED' when 'view' then 'WARNING'
    when 'signup' then 'INFO' else 'SUCCESS' end as status,
  case when event_type = 'click' then cast(floor(value) as bigint) end as records_count,
  case when event_type = 'click' then cast(event_id % 977 as int) end as duration_ms, ts as created_at from events)
"""

#: Mappings over seven databases, what the databases say, and the registered change tables.
REGISTRY = """
  maps as (select mapping_id, flow_id, cdc_enabled, 'db' || (mapping_id - 1) % 7 as db, source_table from mappings),
  dbs as (select distinct 'db' || c_custkey % 7 as db, c_custkey % 7 <> 3 as enabled from customer where c_custkey % 7 <> 5),
  registered as (select 'db' || c_custkey % 7 as db, lower(c_name) as name,
      'dbo_' || case when c_custkey % 4 = 0 then upper(c_name) else c_name end || '_' || i || '_CT' as change_table,
      case when c_custkey % 2 = 0 then i else -i end as registered_at
    from customer, (values (1), (2)) as v(i) where c_custkey % 3 >= i),
  resolved as (select m.mapping_id, case when d.enabled then r.change_table end as change_table, coalesce(r.n, 0) as registrations,
      case when coalesce(d.enabled, false) = false then 'database_not_enabled' when r.change_table is null then 'table_not_registered'
        else 'resolved' end as resolution
    from maps m left join dbs d on m.db = d.db left join (
      select db, name, arg_min(change_table, registered_at) as change_table, count(*) as n from registered group by 1, 2) r
    on m.db = r.db and lower(m.source_table) = r.name)
"""

PRICE = "coalesce(cast(cast(o_totalprice as decimal(38, 6)) as varchar), 'NULL')"
DATE = "coalesce(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f'), 'NULL')"


def _named(name: str) -> str:
    return f"'{name}=' || coalesce(cast({name} as varchar), 'NULL') || '|'"


ORDER_HASH = "md5(" + " || ".join([
    _named("o_custkey"),
    f"'o_orderdate=' || {DATE} || '|'",
    _named("o_orderkey"),
    _named("o_orderpriority"),
    _named("o_orderstatus"),
    f"'o_totalprice=' || {PRICE} || '|'",
]) + ")"


def _tagged(name: str, text: str, length: bool = False) -> str:
    head = f"length({text}) || ':' || " if length else ""
    return f"coalesce('{name}=' || {head}{text} || '|', '{name}|')"


ORDER_TAGGED = "md5(" + " || ".join([
    _tagged("o_custkey", "cast(o_custkey as varchar)"),
    _tagged("o_orderdate", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')"),
    _tagged("o_orderkey", "cast(o_orderkey as varchar)"),
    _tagged("o_orderpriority", "o_orderpriority", True),
    _tagged("o_orderstatus", "o_orderstatus", True),
    _tagged("o_totalprice", "cast(cast(o_totalprice as decimal(38, 6)) as varchar)"),
]) + ")"

DOCUMENT_HASH = "md5(" + " || ".join(_named(c) for c in ("doc_id", "lang", "n_chars", "source", "text")) + ")"


def _tail(n: int) -> str:
    """Comparison of the last n rows of the copy with the source."""
    return f"""
tail as (select * from dst order by o_orderkey desc limit {n}),
dh as (select o_orderkey, {ORDER_HASH} as dst_hash from tail),
sh as (select o_orderkey, {ORDER_HASH} as src_hash from src where o_orderkey in (select o_orderkey from tail)),
cmp as (select dh.o_orderkey, dst_hash, src_hash, case when src_hash is null then 'missing_in_src'
  when src_hash = dst_hash then 'match' else 'different' end as status
  from dh left join sh on dh.o_orderkey = sh.o_orderkey)"""


def _rep(select: str, more: str = "") -> str:
    return f"with {REPLICATION}{',' + more if more else ''} {select}"


def _ctl(select: str, more: str = "") -> str:
    return f"with {CONTROL}{',' + more if more else ''} {select}"


def _clean(column: str) -> str:
    """Text export of a string: tab, line feed and carriage return become one space each."""
    return f"coalesce(translate({column}, chr(9) || chr(10) || chr(13), '   '), '')"


REPLACED = """select * from dst where o_orderkey not in (select o_orderkey from {k})
  union all select * from src where o_orderkey in (select o_orderkey from {k})"""

# The columns and joins of the two views.
VIEW = """l.log_id, f.flow_name, tm.source_database, tm.source_schema, tm.source_table, tm.dest_database, tm.dest_schema,
  tm.dest_table, l.log_type, l.log_message, l.status, l.records_count, l.duration_ms, l.created_at"""

VIEW_JOIN = "from logs l left join mappings tm on l.mapping_id = tm.mapping_id left join flows f on l.flow_id = f.flow_id"

APPLIED = """
latest as (select * from (select *, row_number() over (partition by o_orderkey
    order by start_lsn desc, seqval desc, operation desc) as rn from chg where operation <> 3) where rn = 1)"""

APPLIED_SELECT = """select * from dst where o_orderkey not in (select o_orderkey from latest)
  union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  from latest where operation in (2, 4)"""


def _bucket_side(table: str, prefix: str) -> str:
    sums = ", ".join(
        f"cast(sum(cast('0x' || substr(h, {5 * w + 1}, 5) as bigint)) as bigint) as {prefix}_sum{w}" for w in range(7)
    )
    return f"""(select cast(o_orderkey % 16 as int) as bucket, count(*) as {prefix}_rows, {sums}
  from (select o_orderkey, {ORDER_TAGGED} as h from {table}) group by 1)"""


def _sums(prefix: str) -> str:
    return ", ".join(f"{prefix}_sum{w}" for w in range(7))


#: Column catalogues of all mappings.
CATALOGUES = """
      scol as (select cast(c_custkey + 1 as int) as mapping_id, name, generated from customer,
        (values ('id', null), ('name', null), ('balance', null), ('segment', null), ('version', 'rowversion'),
          ('extra', null)) as v(name, generated)
        where c_custkey % 50 <> 49 and not (name = 'id' and c_custkey % 11 = 0)
          and not (name = 'segment' and c_custkey % 9 = 0)),
      dcol as (select cast(c_custkey + 1 as int) as mapping_id, name, generated from customer,
        (values ('ID', null), ('Name', null), ('balance', null), ('segment', null), ('version', null),
          ('seq', 'identity')) as v(name, generated))"""

ORACLE: dict[str, str] = {
    "scan_full": "select * from orders",
    "scan_by_keys": _rep("select * from src where o_orderkey in (select o_orderkey from kh)"),
    "changes_since": _rep("select * from later"),
    "changes_since_upper_hex": _rep("select * replace (upper(start_lsn) as start_lsn) from later"),
    "changes_since_binary": _rep("select * from later"),
    "full_sync_identity": "select * from orders",
    "tail_by_key": _rep("select * from dst order by o_orderkey desc limit 10"),
    "changed_keys": _rep("select o_orderkey from kh"),
    "lsn_bounds": _rep("select min(start_lsn) as min_lsn, max(start_lsn) as max_lsn from chg"),
    "change_summary": _rep("""select count(*) as changes, count(distinct o_orderkey) as distinct_keys,
      count(*) filter (operation = 1) as deletes, count(*) filter (operation = 2) as inserts,
      count(*) filter (operation = 3) as before_images, count(*) filter (operation = 4) as after_images,
      max(start_lsn) as max_lsn from later"""),
    "apply_counts": _rep("""select (select count(*) from kh) as keys,
      (select count(*) from dst where o_orderkey in (select o_orderkey from kh)) as deleted,
      (select count(*) from src where o_orderkey in (select o_orderkey from kh)) as imported"""),
    "bootstrap_window": _rep("select * from chg where start_lsn > (select min(start_lsn) from chg)"),
    "delete_by_keys": _rep("select * from dst where o_orderkey not in (select o_orderkey from kh)"),
    "replace_by_keys": _rep(REPLACED.format(k="k")),
    "replace_by_keys_window": _rep(REPLACED.format(k="kh")),
    "replace_by_keys_composite": """select conv_id, turn, role, text from conversations
      where (conv_id + turn) % 5 <> 0""",
    "replace_by_keys_lineitem": "select * from lineitem where l_orderkey % 10 <> 7",
    "apply_ops": _rep(APPLIED_SELECT, APPLIED),
    "project_full_sync": "select o_orderkey, o_orderpriority, o_totalprice, o_orderdate, o_orderstatus from orders",
    "project_aligned": "select o_orderkey, o_totalprice, o_orderdate from orders",
    "strip_metadata": _rep("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
      from chg"""),
    "binary_to_hex": _rep("select * from chg"),
    "tsv_encode": f"""select cast(event_id as varchar) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts,
      cast(user_id as varchar) as user_id, {_clean('event_type')} as event_type, cast(value as varchar) as value,
      {_clean('props')} as props from events""",
    "tsv_encode_documents": f"""select cast(doc_id as varchar) as doc_id, {_clean('text')} as text,
      {_clean('lang')} as lang, {_clean('source')} as source, cast(n_chars as varchar) as n_chars from documents""",
    "row_hash": f"select o_orderkey, {ORDER_HASH} as row_hash from orders",
    "row_hash_documents": f"select doc_id, {DOCUMENT_HASH} as row_hash from documents",
    "combined_hash": _rep(f"""select count(*) as rows, md5(string_agg(h, '|' order by kt) || '|') as combined_hash
      from (select cast(o_orderkey as varchar) as kt, {ORDER_HASH} as h
        from (select * from src order by o_orderkey desc limit 10))"""),
    "verify_tail": _rep("""select md5(string_agg(dst_hash, '|' order by cast(o_orderkey as varchar)) || '|') as dst_hash,
      md5(string_agg(src_hash, '|' order by cast(o_orderkey as varchar)) || '|') as src_hash,
      md5(string_agg(dst_hash, '|' order by cast(o_orderkey as varchar)) || '|')
        = md5(string_agg(src_hash, '|' order by cast(o_orderkey as varchar)) || '|') as match,
      count(*) filter (status <> 'match') as mismatches, count(*) filter (status <> 'missing_in_src') as compared
      from cmp""", _tail(10)),
    "verify_tail_rows": _rep("select o_orderkey, status from cmp", _tail(50)),
    "mismatch_sample": _rep("""select o_orderkey, status, (select count(*) from cmp where status <> 'match') as mismatches
      from cmp where status <> 'match' order by o_orderkey desc limit 50""", _tail(500)),
    "verify_buckets": _rep(f"""select bucket, src_rows, dst_rows, src_sum0, src_sum1, src_sum2, dst_sum0, dst_sum1,
      dst_sum2, src_rows = dst_rows and src_sum0 = dst_sum0 and src_sum1 = dst_sum1 and src_sum2 = dst_sum2 as equal
      from {_bucket_side('src', 'src')} s join {_bucket_side('dst', 'dst')} d using (bucket)"""),
    "verify_buckets_all_bits": _rep(f"""select bucket, src_rows, dst_rows, {_sums('src')}, {_sums('dst')},
      src_rows = dst_rows and ({_sums('src')}) = ({_sums('dst')}) as equal
      from {_bucket_side('src', 'src')} s join {_bucket_side('dst', 'dst')} d using (bucket)"""),
    "verify_full": _rep("""select coalesce(s.o_orderkey, d.o_orderkey) as o_orderkey,
      case when s.o_orderkey is null then 'missing_in_src' when d.o_orderkey is null then 'missing_in_dst'
        else 'different' end as status
      from src s full join dst d on s.o_orderkey = d.o_orderkey
      where s.o_orderkey is null or d.o_orderkey is null or s.o_totalprice <> d.o_totalprice
        or s.o_custkey <> d.o_custkey or s.o_orderstatus <> d.o_orderstatus or s.o_orderdate <> d.o_orderdate
        or s.o_orderpriority <> d.o_orderpriority"""),
    **{name: _rep("""select coalesce(s.o_orderkey, d.o_orderkey) as o_orderkey,
      case when s.o_orderkey is null then 'missing_in_src' when d.o_orderkey is null then 'missing_in_dst'
        else 'different' end as status
      from src s full join dst d on s.o_orderkey = d.o_orderkey
      where s.o_orderkey is null or d.o_orderkey is null or s.o_totalprice <> d.o_totalprice""")
      for name in ("verify_full_types", "verify_full_scaled")},
    "verify_full_lineitem": """with s as (select * from lineitem where l_orderkey % 10 <> 7),
      d as (select * replace (case when l_orderkey % 10 = 5 and l_linenumber = 1 then l_tax + 1 else l_tax end as l_tax)
        from lineitem where l_orderkey % 10 <> 3 or l_linenumber <> 2),
      sk as (select l_orderkey, list_sort(list(cast(s as varchar))) as content from s group by 1),
      dk as (select l_orderkey, list_sort(list(cast(d as varchar))) as content from d group by 1)
      select coalesce(sk.l_orderkey, dk.l_orderkey) as l_orderkey, case when sk.l_orderkey is null then 'missing_in_src'
        when dk.l_orderkey is null then 'missing_in_dst' else 'different' end as status
      from sk full join dk on sk.l_orderkey = dk.l_orderkey where sk.content is distinct from dk.content""",
    "verify_full_documents": """select doc_id, case doc_id % 10 when 7 then 'missing_in_src' when 3 then 'missing_in_dst'
      else 'different' end as status from documents
      where doc_id % 10 in (3, 7) or (doc_id % 10 = 5 and text is not null)""",
    "verify_sets_lineitem": """with s as (select * from lineitem where l_orderkey % 100 <> 7),
      d as (select * replace (case when l_orderkey % 100 = 5 and l_linenumber = 1 then l_tax + 1 else l_tax end as l_tax)
        from lineitem where l_orderkey % 100 <> 3 or l_linenumber <> 2),
      sk as (select l_orderkey, list_sort(list(cast(s as varchar))) as content from s group by 1),
      dk as (select l_orderkey, list_sort(list(cast(d as varchar))) as content from d group by 1)
      select l_orderkey, 'missing_in_dst' as status from sk anti join dk using (l_orderkey)
      union all select l_orderkey, 'missing_in_src' from dk anti join sk using (l_orderkey)
      union all select l_orderkey, 'different' from sk join dk using (l_orderkey) where sk.content <> dk.content""",
    "verify_sets_documents": """with s as (select * from documents where doc_id % 100 <> 7),
      d as (select * replace (case when doc_id % 100 = 5 then text || '.' else text end as text)
        from documents where doc_id % 100 <> 3)
      select doc_id, 'missing_in_dst' as status from s anti join d using (doc_id)
      union all select doc_id, 'missing_in_src' from d anti join s using (doc_id)
      union all select s.doc_id, 'different' from s join d using (doc_id) where s.text is distinct from d.text""",
    "ledger_after_changes": _rep(f"""select bucket, copy_rows as rows, {", ".join(f"copy_sum{w} as sum{w}" for w in range(7))}
      from {_bucket_side('copied', 'copy')}""", f"copied as ({REPLACED.format(k='kh')})"),
    "verify_ledger": _rep("""select coalesce(s.o_orderkey, d.o_orderkey) as o_orderkey,
      case when s.o_orderkey is null then 'missing_in_src' when d.o_orderkey is null then 'missing_in_dst'
        else 'different' end as status
      from src s full join copied d on s.o_orderkey = d.o_orderkey
      where s.o_orderkey is null or d.o_orderkey is null or s.o_totalprice <> d.o_totalprice""",
      f"copied as ({REPLACED.format(k='kh')})"),
    "validate_schema": _ctl("""
      select mapping_id, 'source_exists' as check, cast(null as varchar) as column,
        mapping_id in (select mapping_id from scol) as ok from mappings
      union all select mapping_id, 'key_exists', 'id',
        mapping_id in (select mapping_id from scol where lower(name) = 'id') from mappings
        where mapping_id in (select mapping_id from scol)
      union all select d.mapping_id, 'column_in_source', d.name, s.name is not null
        from dcol d left join scol s on d.mapping_id = s.mapping_id and lower(d.name) = lower(s.name)
        where d.mapping_id in (select mapping_id from scol) and d.generated is null and s.generated is null""", CATALOGUES),
    "generated_columns": _ctl("""select d.mapping_id, d.name as "column", s.generated as src_generated,
        d.generated as dst_generated, s.generated is null and d.generated is null as compared,
        s.name is not null and d.generated is distinct from 'identity' as exported
      from dcol d left join scol s on d.mapping_id = s.mapping_id and lower(d.name) = lower(s.name)""", CATALOGUES),
    "reconcile_counts": "select count(*) as exported, count(*) as imported, true as ok from orders",
    "reconcile_counts_mismatch": _rep("""select e.n as exported, i.n as imported, e.n = 0 or e.n = i.n as ok
      from (select count(*) as n from orders) e, (select count(*) as n from dst) i"""),
    "append": _rep("select * from dst union all select * from orders where o_orderkey not in (select o_orderkey from dst)"),
    "cluster_by_key": "select * from lineitem",
    "tsv_roundtrip": f"""select concat_ws(chr(9), cast(doc_id as varchar), {_clean('text')}, {_clean('lang')},
      {_clean('source')}, coalesce(cast(n_chars as varchar), '')) as line from documents""",
    "bounded_pass": _rep(REPLACED.format(k="k")),
    "sync_all": _rep("""select m.mapping_id, 'FULL_SYNC' as log_type, 'INFO' as status, cast(null as bigint) as records_count
        from (values (1), (2), (3), (4)) as m(mapping_id)
      union all select 1, 'FULL_SYNC', 'SUCCESS', (select count(*) from orders)
      union all select 1, 'CDC', 'SUCCESS', 0
      union all select 2, 'FULL_SYNC', 'SUCCESS', (select count(*) from customer)
      union all select 3, 'FULL_SYNC', 'SUCCESS', (select count(*) from events)
      union all select 4, 'CONNECTION', 'ERROR', null
      union all select 4, 'FULL_SYNC', 'ERROR', null"""),
    "verify_all": _rep("""select 1 as mapping_id, 'VERIFICATION' as log_type,
        case when count(*) filter (status <> 'match') = 0 then 'SUCCESS' else 'FAILED' end as status,
        count(*) filter (status <> 'missing_in_src') as records_count from cmp
      union all select 2, 'VERIFICATION', 'SUCCESS', least(10, (select count(*) from customer))
      union all select 3, 'VERIFICATION', 'SUCCESS', least(10, (select count(*) from events))""", _tail(10)),
    "verify_whole": _rep("""select 'VERIFICATION' as log_type, 'FAILED' as status, string_agg(part, ', ' order by part_of) as differences
      from (select part_of, count(*) || ' ' || part_of as part from (
        select case when s.o_orderkey is null then 'missing_in_src' when d.o_orderkey is null then 'missing_in_dst'
          else 'different' end as part_of
        from src s full join dst d on s.o_orderkey = d.o_orderkey
        where s.o_orderkey is null or d.o_orderkey is null or s.o_totalprice <> d.o_totalprice) group by part_of)"""),
    "staged_roundtrip": _rep("select * from src where o_orderkey in (select o_orderkey from kh)"),
    "full_sync": "select * from orders",
    # Greedy passes by recursion over positions with running numbers of changes.
    "passes_of_changes": "with recursive " + _rep("""select pass, to_lsn, cast(changes as bigint) as changes from passes
        where pass >= 0""", """
      counted as (select start_lsn, count(*) as n from chg group by 1),
      running as (select start_lsn, sum(n) over (order by start_lsn) as upto from counted),
      room as (select greatest(1, (count(*) + 7) // 8) as size from chg),
      passes as (
        select -1 as pass, '' as to_lsn, 0 as changes, 0 as upto
        union all
        select p.pass + 1, last.start_lsn, last.upto - p.upto, last.upto
        from passes p, room, lateral (select start_lsn, upto from running where start_lsn > p.to_lsn
          and (upto - p.upto <= size or start_lsn = (select min(start_lsn) from running where start_lsn > p.to_lsn))
          order by start_lsn desc limit 1) last)""")[len("with "):],
    "copy_by_passes_of_changes": _rep(REPLACED.format(k="k")),
    "full_sync_chunked": _rep("select * from src"),
    "cdc_sync": _rep(REPLACED.format(k="kh")),
    "run_logs": _rep("""select 1 as flow_id, 1 as mapping_id, 'FULL_SYNC' as log_type, 'INFO' as status,
      cast(null as bigint) as records_count
      union all select 1, 1, 'FULL_SYNC', 'SUCCESS', (select count(*) from orders)
      union all select 1, 1, 'CDC', 'SUCCESS', 0
      union all select 1, 1, 'VERIFICATION', 'SUCCESS', least(10, (select count(*) from orders))"""),
    "run_state": _rep("select 1 as mapping_id, max(start_lsn) as last_cdc_lsn, true as has_sync_time from chg"),
    "target_passes": _rep("select * from src"),
    "stream_sync": _rep("select * from src"),
    "stream_sync_with_full_sync": _rep("select * from src"),
    "stream_sync_ops": _rep(APPLIED_SELECT, APPLIED),
    "enabled_mappings": _ctl("select mapping_id, flow_id, flow_name, source_table, dest_table, last_cdc_lsn from enabled"),
    "resolve_feeds": _ctl("select * from resolved", REGISTRY),
    "feed_warnings": _ctl("""select flow_id, mapping_id, 'CDC' as log_type, 'WARNING' as status, log_message from (
        select *, case resolution when 'database_not_enabled' then 'No feed: capture is off in the database of ' || name
          when 'table_not_registered' then 'No feed: no change table is registered for ' || name
          else registrations || ' change tables are registered for ' || name || ', reading ' || change_table end as log_message
        from (select *, db || '.dbo.' || source_table as name from maps join resolved using (mapping_id) where cdc_enabled)
        where resolution <> 'resolved' or registrations > 1)""", REGISTRY),
    "route_mappings": _ctl("""select mapping_id, is_full_sync, cdc_enabled, case when is_full_sync and cdc_enabled
      then 'FULL_THEN_CDC' when is_full_sync then 'FULL' when cdc_enabled then 'CDC' else 'NONE' end as action
      from enabled"""),
    "verifiable_mappings": _ctl("select mapping_id, flow_name from enabled where mapping_id % 4 <> 0"),
    "mapping_descriptor": _ctl("""select mapping_id,
      concat('server=', source_server, ';port=', source_port, ';database=', source_database) as source_descriptor,
      concat('server=', dest_server, ';port=', dest_port, ';database=', dest_database) as dest_descriptor from enabled"""),
    "log_messages": _ctl("""select mapping_id, concat('Flow ''', flow_name, ''': Table mapping ''', source_table, ''' (',
      source_database, '.', source_schema, '.', source_table, ' -> ', dest_database, '.', dest_schema, '.', dest_table,
      ') - Full sync started') as log_message from enabled"""),
    "mappings_with_states": f"""with {REPLICATION}, {CONTROL} select mapping_id, is_full_sync,
      case when mapping_id = 1 then (select max(start_lsn) from chg) else last_cdc_lsn end as last_cdc_lsn from enabled""",
    "state_update": f"""with {REPLICATION}, {CONTROL} select mapping_id, is_full_sync,
      case when cdc_enabled then (select max(start_lsn) from chg) else last_cdc_lsn end as last_cdc_lsn from enabled""",
    "recent_logs": _ctl(f"select {VIEW} {VIEW_JOIN} order by l.created_at desc, l.log_id desc, f.flow_name limit 1000"),
    "recent_logs_literal": _ctl(f"""select {VIEW} {VIEW_JOIN} or (tm.flow_id is not null and l.flow_id = tm.flow_id)
      order by l.created_at desc, l.log_id desc, f.flow_name limit 1000"""),
    "recent_errors": _ctl(f"""select l.log_id, f.flow_name, tm.source_table, tm.dest_table, l.log_type, l.log_message,
      l.created_at {VIEW_JOIN} where l.status = 'ERROR'
      order by l.created_at desc, l.log_id desc, f.flow_name limit 100"""),
    "sync_summary": _ctl("""select t.mapping_id, t.log_type, t.entries, t.last_status, t.last_at, t.records, t.errors,
      t.mean_duration_ms, m.source_table, m.dest_table
      from (select mapping_id, log_type, count(*) as entries, arg_max(status, (created_at, log_id)) as last_status,
          max(created_at) as last_at, cast(coalesce(sum(records_count), 0) as bigint) as records,
          count(*) filter (status = 'ERROR') as errors, avg(duration_ms) as mean_duration_ms
        from logs group by mapping_id, log_type) t
      left join mappings m on t.mapping_id = m.mapping_id"""),
}
ORACLE["sync_summary_incremental"] = ORACLE["sync_summary"]
