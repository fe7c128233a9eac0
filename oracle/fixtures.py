"""The derived ledgers in DuckDB SQL, written independently of the Spark version."""

FIXTURES: dict[str, str] = {}

FIXTURES["base"] = """
select o_orderkey as k, o_orderkey % 100 as m, o_orderkey // 100 as q, o_custkey % 25 as ai,
       cast(o_orderdate as date) as d, cast(round(o_totalprice * 100) as bigint) as cents,
       cast(1000000000 + 2 * o_orderkey as varchar) as t1,
       case when o_orderkey % 3 = 0 then cast(1000000001 + 2 * o_orderkey as varchar) end as t2,
       o_orderkey % 10 = 9 as is_payment,
       (cast(round(o_totalprice * 100) as bigint) + 5000) // 10000 * 10000 as paid,
       case when o_orderkey % 3 = 0 then cast(round(o_totalprice * 100) as bigint) // 2
            else cast(round(o_totalprice * 100) as bigint) end as first
from orders
"""

FIXTURES["legs"] = """
with s as (select *, cents - first as second,
                  case when m in (6, 38) then 50000 when m = 37 then cents // 20 else 0 end as over,
                  case when m = 10 then 25000 else 0 end as kept
           from base where not is_payment and m not in (2, 3, 11, 12, 13)),
     p as (select * from base where is_payment and m <> 49)
select k, m, q, d, ai as owner, 1 as number, 'purchase' as kind, t1 as ticket_text, -(first + over) as c, 0 as secs from s
union all select k, m, q, d, ai, 2, 'purchase', '376-' || t2, -second, 1 from s where t2 is not null
union all select k, m, q, d, ai, 3, 'purchase', t1, -first, 300 from s where m = 4
union all select k, m, q, d, ai, 4, 'void', t1, first - kept, 3600 from s where m in (10, 22)
union all select k, m, q, d, ai, 5, 'void', '376-' || t2, second - kept, 3601 from s where m in (10, 22) and t2 is not null
union all select k, m, q, d, (ai + 3) % 25, 6, 'purchase', t1, -1000, 7200 from s where m = 26 and q % 9 = 0
union all select k, m, q, d, ai, 7, 'refund', t1, first // 2, 7300 from s where m = 28
union all select k, m, q, d, ai, 1, 'payment', null, paid, 10800 from p
union all select k, m, q, d, ai, 2, 'payment', null, paid, 18000 from p where m = 59
"""

FIXTURES["ledger_raw"] = """
select 'Agent ' || lpad(cast(owner as varchar), 2, '0') as agent,
       'Agent ' || lpad(cast(owner as varchar), 2, '0') || '/' || cast((k % 7) % 3 as varchar) as agreement_id,
       k * 10 + number as txn_id,
       cast(d as timestamp) + to_seconds(32400 + k % 18000 + secs) as ts,
       kind, ticket_text, cast(c / 100.0 as decimal(18,2)) as amount_orig, 'KGS' as currency,
       cast(c / 100.0 as decimal(18,2)) as amount,
       cast((sum(c) over (partition by owner order by cast(d as timestamp) + to_seconds(32400 + k % 18000 + secs), k * 10 + number
                          rows unbounded preceding)
             + owner * 100000 + case when m = 21 and q % 10 = 4 then 5000 else 0 end) / 100.0 as decimal(18,2)) as balance_after,
       case when m in (8, 21, 23, 38) then 'clerk-' || cast(k % 3 as varchar) else 'ledger-bot' end as creator,
       '' as comment
from legs
"""

FIXTURES["lines"] = """
with s as (select *, case when m in (5, 33, 35) then cents - 30000 when m = 7 then cents - 4000
                          when m = 8 then case when cents // 100000 % 10 < 9 then cents + 100000 else cents - 100000 end
                          when m = 17 then cents - 77700
                          when m = 23 then cents + (cents // 10000 % 10 - cents // 100000 % 10) * 90000
                          when m = 27 then cents - 10000 when m = 36 then cents - cents // 20 else cents end as booked
           from base where not is_payment and m not in (1, 10, 11, 12, 13, 22)),
     l as (
       select k, m, ai, d as doc_date, is_payment, t1, t2, 1 as number, 'Sale order ' as doc, booked as debit, 0 as credit from s
       union all select k, m, ai, d, is_payment, t1, t2, 2, 'Sale service fee ', 10000, 0 from s where m = 27
       union all select k, m, ai, d, is_payment, t1, t2, 3, 'Refund order ', 0, first // 2 from s where m = 28
       union all select k, m, ai, d + cast(q % 5 as integer), is_payment, t1, t2, 1, 'Receipt order ', 0, paid
                 from base where is_payment and m <> 39),
     o as (select *, case when m = 69 then (ai + 1) % 25 when m = 3 and k % 7 = 0 then 25 else ai end as owner from l)
select k, owner, doc_date, doc || cast(k as varchar) as doc, debit, credit,
       case when owner = 25 then 'Dormant Shop'
            when is_payment and owner % 5 = 0 then 'AGENT-' || lpad(cast(owner as varchar), 2, '0')
            else 'Counter ' || lpad(cast(owner as varchar), 2, '0') end as folder,
       case when is_payment then null when t2 is null then t1 else t1 || ' ' || t2 end as ticket_text,
       (year(doc_date) - 1995) * 12 + month(doc_date) - 1 as mi, k * 10 + number as line_no
from o
"""

FIXTURES["months"] = """
with s as (select owner, mi, sum(debit - credit) as moved,
                  coalesce(sum(debit - credit) filter (where k % 10 <> 5), 0) as moved_draft
           from lines group by owner, mi),
     r as (select *, coalesce(sum(moved) over (partition by owner order by mi rows between unbounded preceding and 1 preceding), 0)
                     - owner * 100000 + owner % 4 * 5000 + case when owner = 3 and mi >= 30 then 2750000 else 0 end as st
           from s)
select owner, mi, st, st + moved + case when owner = 4 and mi = 20 then 1000 else 0 end as en, st + moved_draft as en_draft
from r where (owner * 7 + mi) % 61 <> 0
"""

FIXTURES["statements_raw"] = """
with j as (select l.*, st, en, en_draft from lines l join months using (owner, mi)),
     v as (select k, folder, doc_date, doc, debit, credit, ticket_text, line_no, st, en,
                  case when (owner + mi) % 17 = 0 then 'reissued' when (owner + mi) % 19 = 5 then 'draft' end as version from j
           union all
           select k, folder, doc_date, doc, debit, credit, ticket_text, line_no + 5, st, en_draft, 'draft'
           from j where (owner + mi) % 17 = 0 and k % 10 <> 5)
select folder, cast(date_trunc('month', doc_date) as date) as period_start, last_day(doc_date) as period_end, version,
       cast(st / 100.0 as decimal(18,2)) as opening, cast(en / 100.0 as decimal(18,2)) as closing, doc_date, doc,
       case when k % 5 <> 0 then 'INV-' || cast(k as varchar) end as invoice, 'P' || cast(k % 50 as varchar) as pax, ticket_text,
       case when debit <> 0 then cast(debit / 100.0 as decimal(18,2)) end as debit,
       case when credit <> 0 then cast(credit / 100.0 as decimal(18,2)) end as credit, line_no
from v
"""

FIXTURES["journal_raw"] = """
with b as (select *, case when m = 20 then lag(t1) over (partition by m, ai, k // 100000 order by k) end as t0
           from base where not is_payment and m not in (3, 8, 17, 21, 23) and not (m = 1 and k % 3 = 0)),
     c as (select *, case when m in (16, 34) then cents + 100000 when m = 35 then cents + 500000 else cents end as jc,
                  t1 || coalesce('|' || t2, '') || coalesce('|' || t0, '') as tickets from b),
     d as (select *,
             case when m = 15 then '376' || t1
                  when m in (18, 33) then format('{:,.2f}', ((cents * 100 + 4375) // 8750) / 100.0) || ' USD'
                  when m in (36, 37) then format('{:,.2f}', ((cents * 100 + 4390) // 8780) / 100.0) || ' $'
                  when m = 32 then '€ ' || translate(format('{:,.2f}', ((cents * 100 + 4705) // 9410) / 100.0), ',.', '.,')
                  when m = 30 and q % 6 = 0 then null
                  when m = 31 and q % 6 = 0 then 'paid by card'
                  when q % 4 = 0 then format('{:.2f}', jc / 100.0) || ' kgs'
                  when q % 4 = 1 then translate(format('{:,.2f}', jc / 100.0), ',.', '.,') || ' KGS'
                  when q % 4 = 2 then replace(format('{:,.2f}', jc / 100.0), ',', chr(160)) || ' kgs'
                  else format('{:,.2f}', (jc - 10000) / 100.0) || ' KGS + 100 kgs sf' end as cell
           from c),
     r as (select *, 1 as number, case when m = 12 then 'refund' else 'sale' end as kind, tickets as ticket_text, cell as pay_cell from d
           union all select *, 2, 'sale', tickets, cell from d where m in (14, 34)
           union all select *, 3, 'refund', t1, '-' || replace(format('{:,.2f}', (first // 2) / 100.0), ',', ' ') || ' kgs (fine 15%)'
                     from d where m = 28)
select strftime(d, '%d.%m.%Y') as date_text, 'E' || cast(k % 7 as varchar) as employee, kind,
       case when m = 13 then 'Client ' || cast(k % 5 as varchar)
            when m = 25 or (m = 12 and q % 3 = 1) then 'Shared Desk'
            else 'Party ' || lpad(cast(ai as varchar), 2, '0') end as party,
       ticket_text, 'P' || cast(k % 50 as varchar) as pax, 'PNR' || cast(k % 1000 as varchar) as pnr, 'ZZ' as airline,
       'AAA-BBB' as route, pay_cell, cast(87.50 as decimal(18,6)) as rate_usd, cast(94.10 as decimal(18,6)) as rate_eur,
       cast(1.05 as decimal(18,6)) as rate_rub, cast(0.17 as decimal(18,6)) as rate_kzt, k * 10 + number as row_no
from r
"""

FIXTURES["dense_pay"] = """
select 'Agent ' || lpad(cast(ai as varchar), 2, '0') as agent, k * 10 as txn_id,
       cast(date '1997-01-01' + cast(k // 10 % 60 as integer) as timestamp) + to_seconds(k % 86400) as ts,
       cast((cents + 5000000) // 10000000 * 100000 as decimal(18,2)) as amount
from base where is_payment
"""
FIXTURES["dense_receipts"] = """
select 'Agent ' || lpad(cast(ai as varchar), 2, '0') as agent, k * 10 as line_no,
       date '1997-01-01' + cast(k // 10 % 60 + k // 7 % 5 - 1 as integer) as doc_date,
       cast((cents + 5000000) // 10000000 * 100000 as decimal(18,2)) as amount
from base where is_payment and m <> 39
"""
