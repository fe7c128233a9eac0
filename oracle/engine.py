"""The reconciliation in DuckDB SQL: an independent restatement used to check the Spark results."""

import re

from oracle.fixtures import FIXTURES

CTES: dict[str, str] = dict(FIXTURES)


def with_ctes(select: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix a statement with all tables it needs, in order of definition."""
    known = ctes or CTES
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(known[name])
    parts = [f"{name} as ({known[name]})" for name in known if name in needed]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + select


def tickets(text: str) -> str:
    raw = rf"list_transform(regexp_extract_all({text}, '\d{{3}}-\d{{10}}|\d{{10,13}}'), lambda n: right(n, 10))"
    return f"coalesce(list_filter({raw}, lambda v, i: list_position({raw}, v) = i), [])"


def number(token: str) -> str:
    s = f"trim(replace(replace({token}, ' ', ''), chr(160), ''), '.,')"
    d = f"ltrim({s}, '+-')"
    both = f"(contains({d}, ',') and contains({d}, '.'))"
    last = rf"regexp_extract({d}, '([.,])[^.,]*$', 1)"
    value = rf"""case
        when {both} then try_cast(replace(replace({d}, case when {last} = ',' then '.' else ',' end, ''), ',', '.') as decimal(30,8))
        when regexp_matches({d}, '[.,][^.,]*[.,]') then try_cast(regexp_replace({d}, '[.,]', '', 'g') as decimal(30,8))
        when regexp_full_match({d}, '[^.,]{{0,3}}[.,][^.,]{{3}}') and split_part(replace({d}, ',', '.'), '.', 1) <> '0'
             then try_cast(regexp_replace({d}, '[.,]', '', 'g') as decimal(30,8))
        else try_cast(replace({d}, ',', '.') as decimal(30,8)) end"""
    return f"(case when starts_with({s}, '-') then -1 else 1 end * ({value}))"


def digits(x: str) -> str:
    cents = f"cast(cast(round(abs({x}) * 100) as bigint) as varchar)"
    return f"lpad({cents}, cast(greatest(3, length({cents})) as integer), '0')"


def digit_pattern(a: str, b: str) -> str:
    da, db = digits(a), digits(b)
    sa, sb = f"string_split({da}, '')", f"string_split({db}, '')"
    return f"""case when {da} = {db} or length({da}) <> length({db}) then ''
        when list_sort({sa}) = list_sort({sb}) then 'TRANSPOSITION'
        when len(list_filter({sa}, lambda v, i: v <> {sb}[i])) = 1 then 'ONE_WRONG_DIGIT' else '' end"""


def money(x: str, signed: bool = False) -> str:
    shown = f"format('{{:,.2f}}', cast({x} as double))"
    return f"(case when {x} >= 0 then '+' else '' end || {shown})" if signed else shown


C = CTES
# ------------------------------------------------------------------ preparation
C["st_rows"] = f"""
select *, {tickets('ticket_text')} as tickets,
       case when starts_with(doc, 'Sale service fee') then 'service_fee' when starts_with(doc, 'Sale') then 'sale'
            when starts_with(doc, 'Refund') then 'refund' when starts_with(doc, 'Receipt') or starts_with(doc, 'Incoming') then 'receipt'
            else 'other' end as line_kind,
       cast(coalesce(debit, 0) - coalesce(credit, 0) as decimal(18,2)) as mv,
       case version when 'reissued' then 2 when 'draft' then 0 else 1 end as version_rank
from statements_raw
"""
C["st_latest"] = """
select * from st_rows qualify version_rank = max(version_rank) over (partition by folder, period_start)
"""
C["version_diff"] = """
with v as (select folder, period_start,
             arg_min(closing, line_no) filter (where version = 'draft') as cd, arg_min(closing, line_no) filter (where version = 'reissued') as cr,
             arg_min(opening, line_no) filter (where version = 'draft') as od, arg_min(opening, line_no) filter (where version = 'reissued') as orr,
             sum(mv) filter (where version = 'draft') as md, sum(mv) filter (where version = 'reissued') as mr,
             count(*) filter (where version = 'draft') as nd, count(*) filter (where version = 'reissued') as nr
           from st_rows group by folder, period_start),
     dk as (select distinct folder, period_start, doc, coalesce(invoice, '') as inv from st_rows where version = 'draft'),
     rk as (select distinct folder, period_start, doc, coalesce(invoice, '') as inv from st_rows where version = 'reissued'),
     onlyr as (select folder, period_start, count(*) as n from rk anti join dk using (folder, period_start, doc, inv) group by 1, 2),
     onlyd as (select folder, period_start, count(*) as n from dk anti join rk using (folder, period_start, doc, inv) group by 1, 2)
select folder, strftime(period_start, '%Y-%m') as period, cast(cd as double) as closing_draft, cast(cr as double) as closing_reissued,
       cast(cr - cd as double) as closing_delta, nd as rows_draft, nr as rows_reissued,
       coalesce(onlyr.n, 0) as rows_only_in_reissued, coalesce(onlyd.n, 0) as rows_only_in_draft,
       cast(cd - od - md as double) as draft_check, cast(cr - orr - mr as double) as reissued_check
from v left join onlyr using (folder, period_start) left join onlyd using (folder, period_start) where nd > 0 and nr > 0
"""
C["led"] = f"select *, {tickets('ticket_text')} as tickets, cast(ts as date) as day, strftime(ts, '%Y-%m') as month from ledger_raw"
C["parts"] = r"""
with marked as (select row_no, rate_usd, rate_eur, rate_rub, rate_kzt,
     regexp_replace(regexp_replace(regexp_replace(replace(upper(pay_cell), chr(160), ' '), '\(.*?\)', ' ', 'g'),
                    '\s\+\s', chr(1), 'g'), '\+(\s*[A-ZА-Я$€0-9])', chr(1) || '\1', 'g') as t from journal_raw)
select row_no, rate_usd, rate_eur, rate_rub, rate_kzt, unnest(string_split(t, chr(1))) as part from marked
"""
C["amounts"] = f"""
with n as (select *, {number("regexp_extract(part, '[-+]?[0-9][0-9 .,]*[0-9]|[-+]?[0-9]')")} as v,
             case when contains(part, 'KGS') or contains(part, 'СОМ') then 1.0
                  when contains(part, 'USD') or contains(part, '$') then rate_usd
                  when contains(part, 'EUR') or contains(part, '€') then rate_eur
                  when contains(part, 'RUB') or contains(part, 'РУБ') then rate_rub
                  when contains(part, 'KZT') or contains(part, 'ТГ') or contains(part, 'ТЕНГЕ') then rate_kzt else 1.0 end as rate
           from parts)
select row_no, cast(sum(try_cast(v as decimal(24,8)) * try_cast(rate as decimal(12,6))) as decimal(30,8)) as amount from n group by row_no
"""
C["jou"] = rf"""
select j.*, row_number() over (partition by date_text, employee, kind, party, ticket_text, pax, pnr, airline, route, pay_cell,
                               rate_usd, rate_eur, rate_rub, rate_kzt order by j.row_no) > 1 as is_copy,
       cast(try_strptime(date_text, '%d.%m.%Y') as date) as day, {tickets('ticket_text')} as tickets,
       case when coalesce(regexp_full_match(pay_cell, '\s*\d{{10,13}}\s*'), false) then null else a.amount end as amount,
       coalesce(regexp_matches(pay_cell, '(?i)USD|EUR|RUB|KZT|\$|€'), false) as is_foreign,
       case when coalesce(regexp_full_match(pay_cell, '\s*\d{{10,13}}\s*'), false) then 'TICKET_IN_AMOUNT'
            when a.amount is null then 'UNPARSEABLE' else '' end as amount_issue
from journal_raw j left join amounts a using (row_no)
"""
# ------------------------------------------------------------------ names
C["led_occ"] = "select agent, unnest(tickets) as ticket from led"
C["owners"] = """
select ticket, first_agent as agent, count(*) as n, count(*) filter (where a <> first_agent) as conflicts
from (select ticket, agent as a, min(agent) over (partition by ticket) as first_agent from led_occ) group by ticket, first_agent
"""
C["st_occ"] = "select folder, line_no, unnest(tickets) as ticket, generate_subscripts(tickets, 1) as pos from st_latest"
C["folder_votes"] = """
select folder, o.agent, count(*) as n, min(line_no * 1000 + pos) as first from st_occ join owners o using (ticket) group by folder, o.agent
"""
C["folder_map"] = """
with best as (select folder, agent, n, n / sum(n) over (partition by folder) as share
              from folder_votes qualify row_number() over (partition by folder order by n desc, first) = 1),
     named as (select trim(regexp_replace(replace(upper(agent), 'Ё', 'Е'), '[^A-ZА-Я0-9]+', ' ', 'g')) as nm, max(agent) as agent
               from led group by 1)
select f.folder, coalesce(best.agent, named.agent, 'UNMAPPED:' || f.folder) as agent, coalesce(best.n, 0) as shared_tickets,
       coalesce(best.share, case when named.agent is not null then 1.0 else 0.0 end) as confidence
from (select distinct folder from st_latest) f left join best using (folder)
left join named on named.nm = trim(regexp_replace(replace(upper(f.folder), 'Ё', 'Е'), '[^A-ZА-Я0-9]+', ' ', 'g'))
"""
C["t2a"] = """
select ticket, agent from owners
union all
select ticket, arg_min(m.agent, line_no * 1000 + pos) from st_occ join folder_map m using (folder)
where ticket not in (select ticket from owners) group by ticket
"""
C["jou_occ"] = "select party, row_no, unnest(tickets) as ticket, generate_subscripts(tickets, 1) as pos from jou"
C["party_map"] = """
with v as (select party, agent, count(*) as n, min(row_no * 1000 + pos) as first from jou_occ join t2a using (ticket) group by party, agent)
select party, agent, n as shared_tickets, n / sum(n) over (partition by party) as confidence
from v qualify row_number() over (partition by party order by n desc, first) = 1
"""
C["st"] = "select l.*, m.agent from st_latest l join folder_map m using (folder)"
C["jo"] = """
with v as (select row_no, agent, count(*) as n, min(pos) as first from jou_occ join t2a using (ticket) group by row_no, agent),
     b as (select row_no, agent as by_ticket from v qualify row_number() over (partition by row_no order by n desc, first) = 1)
select j.*, coalesce(by_ticket, case when p.confidence >= 0.9 then p.agent when p.confidence < 0.9 then 'UNASSIGNED' else 'DIRECT_CLIENT' end) as agent
from jou j left join b using (row_no) left join party_map p using (party)
"""
# ------------------------------------------------------------------ periods
C["windows"] = "select agent, min(period_start) as window_start, max(period_end) as window_end from st group by agent"
C["missing"] = """
with span as (select date_trunc('month', min(period_start)) as lo, date_trunc('month', max(period_end)) as hi from st),
     m as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from span)
select agent, month from windows cross join m
except select agent, cast(date_trunc('month', period_end) as date) from st
"""
C["flagged"] = """
select agent, month from missing union select agent, cast(month - interval 1 month as date) from missing
"""
C["led_in"] = """
select l.* from led l join windows w using (agent) where l.day >= w.window_start and l.day <= w.window_end
"""
# ------------------------------------------------------------------ components and groups
C["edges"] = """
with r as (select agent, tickets from st union all select agent, tickets from led_in union all select agent, tickets from jo)
select distinct agent || '|' || tickets[1] as a, agent || '|' || t as b
from (select agent, tickets, unnest(tickets[2:]) as t from r where len(tickets) > 1) where tickets[1] <> t
"""
C["reach"] = """
select a, b from edges union select b, a from edges union select a, a from edges union select b, b from edges
union
select r.a, e.b from reach r join (select a, b from edges union all select b, a from edges) e on r.b = e.a
"""
C["roots"] = "select a as node, min(b) as root from reach group by a"
for _name, _source in (("st_g", "st"), ("led_g", "led_in"), ("jo_g", "jo")):
    C[_name] = f"""
select s.*, case when len(tickets) > 0 then coalesce(r.root, s.agent || '|' || tickets[1]) end as gid
from {_source} s left join roots r on r.node = s.agent || '|' || s.tickets[1]
"""
C["g_tickets"] = """
select distinct gid, agent, unnest(tickets) as ticket
from (select gid, agent, tickets from st_g where gid is not null union all select gid, agent, tickets from led_g where gid is not null
      union all select gid, agent, tickets from jo_g where gid is not null)
"""
C["g_st"] = """
select gid, sum(mv) as statement_sum, count(*) as statement_rows, min(doc_date) as statement_first, max(doc_date) as statement_last
from st_g where gid is not null and line_kind <> 'receipt' group by gid
"""
C["g_docs"] = """
with d as (select gid, doc, min(line_no) as o from st_g where gid is not null and line_kind <> 'receipt' group by gid, doc)
select gid, string_agg(doc, ' | ' order by o) as statement_docs
from (select * from d qualify row_number() over (partition by gid order by o) <= 3) group by gid
"""
C["g_led"] = """
select gid, sum(amount) as ledger_sum, count(*) as ledger_rows, min(ts) as ledger_first, max(ts) as ledger_last,
       string_agg(distinct kind, '|' order by kind) as ledger_kinds, string_agg(distinct creator, '|' order by creator) as ledger_creators,
       bool_or(creator = 'ledger-bot') as by_bot, bool_or(kind = 'void') as has_void, bool_or(kind = 'refund') as has_refund
from led_g where gid is not null group by gid
"""
C["g_txns"] = """
select gid, string_agg(cast(txn_id as varchar), ',' order by ts, txn_id) as ledger_txns
from (select * from led_g where gid is not null qualify row_number() over (partition by gid order by ts, txn_id) <= 6) group by gid
"""
C["g_dup"] = """
select gid, sum(amount * (n - 1)) as extra_amount, sum(n - 1) as extra_rows
from (select gid, ticket_text, amount, count(*) as n from led_g where gid is not null and kind = 'purchase'
      group by gid, ticket_text, amount having count(*) > 1) group by gid
"""
C["g_jo"] = """
select gid, sum(amount) filter (where not is_copy) as journal_sum, count(*) filter (where not is_copy) as journal_rows,
       count(*) filter (where not is_copy and amount is null) as journal_unread,
       coalesce(bool_or(is_foreign) filter (where not is_copy), false) as journal_foreign,
       string_agg(distinct kind, '|' order by kind) filter (where not is_copy) as journal_kinds,
       string_agg(distinct employee, '|' order by employee) filter (where not is_copy) as employees,
       string_agg(distinct amount_issue, '|' order by amount_issue) filter (where not is_copy and amount_issue <> '') as journal_issue,
       count(*) filter (where is_copy) as journal_copies
from jo_g where gid is not null group by gid
"""
C["g0"] = """
with t as (select gid, min(agent) as agent, string_agg(ticket, '|' order by ticket) as tickets, count(*) as ticket_count from g_tickets group by gid)
select t.*, cast(coalesce(statement_sum, 0) as decimal(18,2)) as statement_sum, coalesce(statement_rows, 0) as statement_rows,
       statement_first, statement_last, cast(coalesce(ledger_sum, 0) as decimal(18,2)) as ledger_sum, coalesce(ledger_rows, 0) as ledger_rows,
       ledger_first, ledger_last, coalesce(ledger_kinds, '') as ledger_kinds, coalesce(ledger_creators, '') as ledger_creators,
       coalesce(by_bot, false) as by_bot, coalesce(has_void, false) as has_void, coalesce(has_refund, false) as has_refund,
       journal_sum, coalesce(journal_rows, 0) as journal_rows, coalesce(journal_unread, 0) as journal_unread,
       coalesce(journal_foreign, false) as journal_foreign, coalesce(journal_kinds, '') as journal_kinds, coalesce(employees, '') as employees,
       coalesce(journal_issue, '') as journal_issue, coalesce(journal_copies, 0) as journal_copies,
       coalesce(statement_docs, '') as statement_docs, coalesce(ledger_txns, '') as ledger_txns,
       cast(coalesce(extra_amount, 0) as decimal(18,2)) as extra_amount, coalesce(extra_rows, 0) as extra_rows,
       cast(coalesce(statement_sum, 0) + coalesce(ledger_sum, 0) as decimal(18,2)) as residual
from t left join g_st using (gid) left join g_led using (gid) left join g_jo using (gid) left join g_docs using (gid)
left join g_txns using (gid) left join g_dup using (gid)
"""
C["verdicts"] = f"""
with x as (select g0.*, f.month is not null as month_missing, statement_rows > 0 as hs, ledger_rows > 0 as hl, journal_rows > 0 as hj,
             journal_rows > 0 and journal_unread = 0 and journal_sum is not null as rd,
             abs(journal_sum - statement_sum) as ds, abs(journal_sum + ledger_sum) as dl,
             abs(journal_sum - statement_sum) <= case when journal_foreign then greatest(5, 0.005 * abs(statement_sum)) else 5 end as like_s,
             abs(journal_sum + ledger_sum) <= case when journal_foreign then greatest(5, 0.005 * abs(ledger_sum)) else 5 end as like_l,
             {digit_pattern('statement_sum', 'ledger_sum')} as pattern
           from g0 left join flagged f on f.agent = g0.agent and f.month = cast(date_trunc('month', ledger_first) as date)),
     y as (select *, case
       when hl and not hs then case when has_void and abs(ledger_sum) <= 5 then 1 when has_void then 2 when month_missing then 3 else 4 end
       when hs and not hl then case when hj then 5 else 6 end
       when hs and hl and abs(residual) <= 5 then
            case when journal_copies > 0 then case when rd and not like_s then 7 else 8 end when rd and by_bot and not like_s then 9 else 10 end
       when hs and hl then case
            when extra_rows > 0 and abs(residual - extra_amount) <= 5 then 11 when abs(residual) < 100 then 12
            when rd then case when ds < 5 and dl >= 5 then 13 when dl < 5 and ds >= 5 then 14 when like_l and not like_s then 15
                              when like_s and not like_l then 16 else 17 end
            when pattern <> '' and not by_bot then 18 else 19 end
       when agent = 'DIRECT_CLIENT' then 20 when hj and journal_kinds = 'sale' then 21 else 22 end as r0 from x),
     z as (select *, case when r0 = 10 and journal_issue = 'TICKET_IN_AMOUNT' then 23 else r0 end as rule from y),
     s as (select *, case rule when 1 then 'VOID_CLOSED' when 2 then 'VOID_UNBALANCED' when 3 then 'LEDGER_IN_MISSING_MONTH' when 4 then 'NOT_IN_STATEMENT'
             when 5 then 'STATEMENT_ONLY_JOURNAL_SALE' when 6 then 'STATEMENT_ONLY' when 7 then 'JOURNAL_AMOUNT_DIFF' when 8 then 'JOURNAL_DUPLICATE'
             when 9 then 'JOURNAL_AMOUNT_DIFF' when 10 then 'OK' when 11 then 'DOUBLE_DEBIT' when 20 then 'DIRECT_CLIENT' when 21 then 'JOURNAL_ONLY_SALE'
             when 22 then 'JOURNAL_ONLY_OTHER' when 23 then 'TICKET_IN_AMOUNT' else 'AMOUNT_RESIDUAL' end as status,
           case when rule in (1, 10, 20) then 'OK' when rule in (2, 5, 11) then 'BOT' when rule = 3 then 'EXPORT' when rule in (4, 14, 15, 18) then 'STATEMENT'
                when rule in (7, 8, 9, 23) then 'AGENT' when rule in (13, 16) and by_bot then 'BOT' else 'REVIEW' end as error_source,
           case when rule = 4 then case when hj or not by_bot then 'A' else 'B' end
                when rule in (1, 5, 10, 11, 13, 14, 15, 16, 20, 23) then 'A' when rule in (2, 3, 7, 8, 9, 12, 18) then 'B' else 'C' end as confidence,
           case when rule in (2, 5, 11) then 'ledger' when rule in (4, 14, 15, 18) then 'statement' when rule in (3, 6, 12, 17, 19) then 'clarify'
                when rule in (13, 16) then case when by_bot then 'ledger' else 'clarify' end else 'none' end as fix_side
           from z)
select *, cast(case when status in ('JOURNAL_ONLY_SALE', 'JOURNAL_ONLY_OTHER', 'DIRECT_CLIENT') then 0 else residual end as decimal(18,2)) as gap_effect,
       case when status = 'AMOUNT_RESIDUAL' then pattern else '' end as amount_pattern,
       datediff('day', cast(ledger_first as date), statement_first) as lag_days
from s
"""


# ------------------------------------------------------------------ payments
def greedy(prefix: str, candidates: str) -> None:
    """Step through the proposers of each scope in turn; `candidates` lists their seats in order of liking."""
    C[f"{prefix}_cand"] = candidates
    C[f"{prefix}_turns"] = f"""
select scope, proposer, seats, row_number() over (partition by scope order by t1, t2) as n
from (select scope, proposer, t1, t2, list(seat order by l1, l2, l3, l4, l5) as seats from {prefix}_cand group by scope, proposer, t1, t2)
"""
    C[f"{prefix}_walk"] = f"""
select scope, cast(0 as bigint) as n, cast([] as bigint[]) as used, cast(null as bigint) as proposer, cast(null as bigint) as seat
from (select distinct scope from {prefix}_turns)
union all
select w.scope, t.n, case when p.seat is null then w.used else list_append(w.used, p.seat) end, t.proposer, p.seat
from {prefix}_walk w join {prefix}_turns t on t.scope = w.scope and t.n = w.n + 1,
     lateral (select list_filter(t.seats, lambda s: not list_contains(w.used, s))[1] as seat) p
"""
    C[f"{prefix}_pairs"] = f"select proposer, seat from {prefix}_walk where seat is not null"


C["pay"] = "select agent, txn_id, ts, day, amount from led_in where kind = 'payment'"
C["rec"] = "select agent, line_no, doc_date, doc, cast(-mv as decimal(18,2)) as amount from st where line_kind = 'receipt'"
greedy("near", """
select p.agent as scope, p.txn_id as proposer, r.line_no as seat, epoch_us(p.ts) as t1, p.txn_id as t2,
       abs(datediff('day', p.day, r.doc_date)) as l1, epoch_us(cast(r.doc_date as timestamp)) as l2, r.amount as l3, r.line_no as l4, 0 as l5
from pay p join rec r on r.agent = p.agent and abs(r.amount - p.amount) <= 1 and abs(datediff('day', p.day, r.doc_date)) <= 7
""")
C["pay_open"] = """
with h as (select *, case when agent is not null and amount is not null then
       date_diff('microsecond', lag(ts) over (partition by agent, amount order by ts, txn_id), ts) / 3.6e9 end as hours from pay)
select h.*, case when hours <= 72 then 'REPEATED_CREDIT' when f.month is not null then 'PAYMENT_IN_MISSING_MONTH' else 'PAYMENT_NOT_IN_STATEMENT' end as status
from h left join flagged f on f.agent = h.agent and f.month = cast(date_trunc('month', ts) as date)
where txn_id not in (select proposer from near_pairs)
"""
C["rec_open"] = "select * from rec where line_no not in (select seat from near_pairs)"
greedy("swap", """
select 'all' as scope, r.line_no as proposer, p.txn_id as seat, r.line_no as t1, 0 as t2,
       p.agent as l1, p.amount as l2, p.day as l3, epoch_us(p.ts) as l4, p.txn_id as l5
from rec_open r join pay_open p on p.agent <> r.agent and abs(r.amount - p.amount) <= 1 and abs(datediff('day', p.day, r.doc_date)) <= 10
where p.status <> 'REPEATED_CREDIT'
""")
C["exceptions"] = f"""
select agent, ts, 'LEDGER' as found_in, cast(txn_id as varchar) as reference, txn_id, amount,
       case when s.seat is not null then 'PAYMENT_WRONG_AGENT' else status end as status,
       case when s.seat is not null or status = 'REPEATED_CREDIT' then 'BOT' when status = 'PAYMENT_IN_MISSING_MONTH' then 'EXPORT' else 'STATEMENT' end as error_source,
       case when s.seat is null and status = 'REPEATED_CREDIT' then 'A' else 'B' end as confidence,
       case when s.seat is not null then 'Payment of ' || {money('amount')} || ' was credited here, the receipt is booked to another agent'
            when status = 'REPEATED_CREDIT' then 'Payment of ' || {money('amount')} || ' was credited again after ' || format('{{:.1f}}', hours) || ' h; one receipt only'
            when status = 'PAYMENT_IN_MISSING_MONTH' then 'Payment in the ledger, but the statement of that month is missing'
            else 'Payment of ' || {money('amount')} || ' is in the ledger without a receipt' end as explanation,
       case when s.seat is not null or status = 'REPEATED_CREDIT' then 'ledger' when status = 'PAYMENT_IN_MISSING_MONTH' then 'clarify' else 'statement' end as fix_side,
       amount as gap_effect
from pay_open left join swap_pairs s on s.seat = txn_id
union all
select r.agent, cast(r.doc_date as timestamp), 'STATEMENT', r.doc, null, r.amount,
       case when p.agent is not null then 'PAYMENT_WRONG_AGENT' else 'PAYMENT_NOT_IN_LEDGER' end, 'BOT', 'B',
       'Receipt of ' || {money('r.amount')} || case when p.agent is not null then ' is booked here, the ledger credited ' || p.agent else ' never reached the ledger' end,
       'ledger', -r.amount
from rec_open r left join swap_pairs s on s.proposer = r.line_no left join pay_open p on p.txn_id = s.seat
"""
greedy("dense", """
select p.agent as scope, p.txn_id as proposer, r.line_no as seat, epoch_us(p.ts) as t1, p.txn_id as t2,
       abs(datediff('day', cast(p.ts as date), r.doc_date)) as l1, r.doc_date as l2, r.amount as l3, r.line_no as l4, 0 as l5
from dense_pay p join dense_receipts r on r.agent = p.agent and abs(r.amount - p.amount) <= 1
     and abs(datediff('day', cast(p.ts as date), r.doc_date)) <= 7
""")
# ------------------------------------------------------------------ balances
C["opens"] = """
select agent, arg_min(balance_after, (ts, txn_id)) - arg_min(amount, (ts, txn_id)) as opening_balance, sum(amount) as moved,
       arg_max(balance_after, (ts, txn_id)) as last_balance,
       arg_min(balance_after, (ts, txn_id)) - arg_min(amount, (ts, txn_id)) + sum(amount) - arg_max(balance_after, (ts, txn_id)) as chain_check
from led group by agent
"""
C["breaks"] = """
select * from (select agent, ts, txn_id, amount, balance_after, lag(balance_after) over (partition by agent order by ts, txn_id) as previous_balance from led)
where abs(balance_after - previous_balance - amount) > 1
"""
C["acts0"] = """
select agent, period_start, period_end, arg_min(opening, line_no) as opening, arg_min(closing, line_no) as closing, sum(mv) as mv, count(*) as rows,
       arg_min(version, line_no) as version, arg_min(folder, line_no) as folder
from st group by agent, period_start, period_end
"""
C["acts"] = """
with a as (select *, closing - opening - mv as internal_delta, lag(closing) over w as previous_closing, lag(period_end) over w as previous_end
           from acts0 window w as (partition by agent order by period_start, period_end))
select *, opening - previous_closing as jump, coalesce(datediff('day', previous_end, period_start) = 1, false) as consecutive,
       coalesce(abs(opening - previous_closing) > 0.01 and datediff('day', previous_end, period_start) = 1, false) as continuity_break,
       coalesce(abs(opening - previous_closing) > 0.01 and datediff('day', previous_end, period_start) <> 1, false) as jump_over_missing
from a
"""
C["points"] = """
with b as (select agent, period_start as boundary from acts union select agent, period_end + 1 from acts
           union select agent, window_start from windows union select agent, window_end + 1 from windows)
select b.agent, b.boundary, coalesce(max(o.opening_balance), 0) + coalesce(sum(l.amount), 0) as balance
from b left join opens o using (agent) left join led l on l.agent = b.agent and l.ts < b.boundary group by b.agent, b.boundary
"""
C["monthly"] = """
select a.agent, strftime(a.period_end, '%Y-%m') as month, a.opening, a.closing, a.mv as statement_moved, a.internal_delta,
       s.balance as ledger_start, e.balance as ledger_end, e.balance - s.balance as ledger_moved,
       a.opening + s.balance as gap_start, a.closing + e.balance as gap_end, a.closing + e.balance - a.opening - s.balance as gap_change,
       a.internal_delta + a.mv + e.balance - s.balance as identity_expected,
       a.closing + e.balance - a.opening - s.balance - (a.internal_delta + a.mv + e.balance - s.balance) as identity_residual,
       case when abs(a.jump) > 0.01 then a.jump else 0 end as opening_jump, a.continuity_break
from acts a join points s on s.agent = a.agent and s.boundary = a.period_start join points e on e.agent = a.agent and e.boundary = a.period_end + 1
"""
C["bridge0"] = """
with a as (select agent, min(period_start) as window_start, max(period_end) as window_end, arg_min(opening, (period_start, period_end)) as op,
             arg_max(closing, (period_start, period_end)) as cl, sum(jump) filter (where continuity_break) as continuity_breaks,
             sum(jump) filter (where jump_over_missing) as jumps_over_missing, sum(internal_delta) as statement_arithmetic from acts group by agent),
     g as (select agent,
             sum(gap_effect) filter (where status in ('OK', 'VOID_CLOSED', 'JOURNAL_AMOUNT_DIFF', 'TICKET_IN_AMOUNT', 'JOURNAL_DUPLICATE')) as rounding,
             sum(gap_effect) filter (where status = 'AMOUNT_RESIDUAL' and error_source = 'STATEMENT') as residual_statement,
             sum(gap_effect) filter (where status = 'AMOUNT_RESIDUAL' and error_source = 'BOT') as residual_bot,
             sum(gap_effect) filter (where status = 'AMOUNT_RESIDUAL' and error_source = 'REVIEW') as residual_review,
             sum(gap_effect) filter (where status = 'DOUBLE_DEBIT') as double_debit,
             sum(gap_effect) filter (where status = 'STATEMENT_ONLY_JOURNAL_SALE') as statement_only_journal_sale,
             sum(gap_effect) filter (where status = 'STATEMENT_ONLY') as statement_only,
             sum(gap_effect) filter (where status = 'NOT_IN_STATEMENT') as not_in_statement,
             sum(gap_effect) filter (where status = 'VOID_UNBALANCED') as void_unbalanced,
             sum(gap_effect) filter (where status = 'LEDGER_IN_MISSING_MONTH') as ledger_in_missing_month from verdicts group by agent),
     p as (select agent, sum(gap_effect) filter (where status = 'PAYMENT_NOT_IN_STATEMENT') as payment_not_in_statement,
             sum(gap_effect) filter (where status = 'PAYMENT_NOT_IN_LEDGER') as payment_not_in_ledger,
             sum(gap_effect) filter (where status = 'REPEATED_CREDIT') as repeated_credit,
             sum(gap_effect) filter (where status = 'PAYMENT_WRONG_AGENT') as payment_wrong_agent,
             sum(gap_effect) filter (where status = 'PAYMENT_IN_MISSING_MONTH') as payment_in_missing_month from exceptions group by agent)
select a.agent, a.window_start, a.window_end, a.cl + e.balance as gap_close, a.op + s.balance as opening_gap,
       a.continuity_breaks, a.jumps_over_missing, a.statement_arithmetic, g.* exclude (agent), p.* exclude (agent)
from a join points s on s.agent = a.agent and s.boundary = a.window_start join points e on e.agent = a.agent and e.boundary = a.window_end + 1
left join g on g.agent = a.agent left join p on p.agent = a.agent
"""
COMPONENTS = (
    "opening_gap continuity_breaks jumps_over_missing statement_arithmetic rounding residual_statement residual_bot residual_review "
    "double_debit statement_only_journal_sale statement_only not_in_statement void_unbalanced ledger_in_missing_month "
    "payment_not_in_statement payment_not_in_ledger repeated_credit payment_wrong_agent payment_in_missing_month").split()
_total = " + ".join(f"coalesce({c}, 0)" for c in COMPONENTS)
C["bridge"] = f"""
select agent, window_start, window_end, gap_close, {", ".join(f"coalesce({c}, 0) as {c}" for c in COMPONENTS)},
       {_total} as components_sum, gap_close - ({_total}) as unexplained from bridge0
"""
LEDGER_SIDE = "residual_bot double_debit statement_only_journal_sale void_unbalanced payment_not_in_ledger repeated_credit payment_wrong_agent".split()
STATEMENT_SIDE = "residual_statement not_in_statement payment_not_in_statement continuity_breaks statement_arithmetic".split()
CLARIFY_SIDE = "opening_gap jumps_over_missing residual_review statement_only ledger_in_missing_month payment_in_missing_month".split()
GROUP_STATUSES = (
    "OK VOID_CLOSED VOID_UNBALANCED LEDGER_IN_MISSING_MONTH NOT_IN_STATEMENT STATEMENT_ONLY_JOURNAL_SALE STATEMENT_ONLY "
    "JOURNAL_AMOUNT_DIFF JOURNAL_DUPLICATE DOUBLE_DEBIT AMOUNT_RESIDUAL DIRECT_CLIENT JOURNAL_ONLY_SALE JOURNAL_ONLY_OTHER TICKET_IN_AMOUNT").split()
PAYMENT_STATUSES = "REPEATED_CREDIT PAYMENT_IN_MISSING_MONTH PAYMENT_NOT_IN_STATEMENT PAYMENT_WRONG_AGENT PAYMENT_NOT_IN_LEDGER".split()
_count = lambda names: ", ".join(f"count(*) filter (where status = '{s}') as n_{s}" for s in names)
C["group_counts"] = f"select agent, {_count(GROUP_STATUSES)} from verdicts group by agent"
C["payment_counts"] = f"select agent, {_count(PAYMENT_STATUSES)} from exceptions group by agent"


def _labels(pairs) -> str:
    items = " || ".join(
        f"case when n_{s} > 0 then '; {label}: ' || cast(n_{s} as varchar) else '' end" for s, label in pairs)
    return f"case when ({items}) = '' then '' else ' (' || substr({items}, 3) || ')' end"


C["actions"] = f"""
with c as (select b.*, {", ".join(f"coalesce(n_{s}, 0) as n_{s}" for s in GROUP_STATUSES + PAYMENT_STATUSES)}, coalesce(mm.n, 0) as missing_months,
             -({" + ".join(LEDGER_SIDE)}) as ledger_adjust, -({" + ".join(STATEMENT_SIDE)}) as statement_adjust, {" + ".join(CLARIFY_SIDE)} as to_clarify
           from bridge b left join group_counts using (agent) left join payment_counts using (agent)
           left join (select agent, count(*) as n from missing group by agent) mm using (agent)),
     d as (select *, gap_close + ledger_adjust + statement_adjust as gap_after_fixes,
             abs(ledger_adjust) + abs(statement_adjust) + abs(to_clarify) as priority,
             case when abs(ledger_adjust) >= 1 then '; Move the ledger balance by ' || {money('ledger_adjust', True)} || {_labels([
                 ('DOUBLE_DEBIT', 'double debit'), ('STATEMENT_ONLY_JOURNAL_SALE', 'sale not carried over'), ('REPEATED_CREDIT', 'repeated payment'),
                 ('PAYMENT_NOT_IN_LEDGER', 'payment not credited'), ('PAYMENT_WRONG_AGENT', 'payment to another agent')])} else '' end
             || case when abs(statement_adjust) >= 1 then '; Correct the statements by ' || {money('statement_adjust', True)} || {_labels([
                 ('NOT_IN_STATEMENT', 'not invoiced'), ('PAYMENT_NOT_IN_STATEMENT', 'payment not booked')])} else '' end
             || case when abs(to_clarify) >= 1 then '; First clarify ' || {money('to_clarify', True)}
                     || ' (opening gap, missing statements, disputed amounts)' else '' end as txt from c)
select * exclude (txt), gap_after_fixes - (to_clarify + rounding + unexplained) as check_after_fixes,
       case when txt = '' then 'Nothing to do' else substr(txt, 3) end as recommended_action,
       case when priority < 1 then 'OK' else 'ACTION_REQUIRED' end as status from d
"""
