"""One DuckDB statement per registered query, on the same tables."""

from oracle.engine import COMPONENTS, GROUP_STATUSES, digit_pattern, money, number, tickets, with_ctes

from triledger.vocabulary import SOURCE_LABELS, SOURCE_OWNERS, STATUS_LABELS

ORACLE: dict[str, str] = {}
PLAIN: dict[str, str] = {}  # the same without the shared steps


def d(*columns: str) -> str:
    return ", ".join(f"cast({c} as double) as {c}" for c in columns)


def n(*columns: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


def day(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d') as {c}" for c in columns)


def ts(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in columns)


def joined(column: str) -> str:
    return f"array_to_string({column}, '|') as {column}"


def add(name: str, sql: str) -> None:
    # A statement with tables of its own goes into a subquery, after the shared tables.
    PLAIN[name] = sql
    ORACLE[name] = with_ctes(f"select * from ({sql})" if sql.lstrip().startswith("with") else sql)


add("q01_load_csv", """
select 'statements' as source, count(*) as rows, cast(sum(coalesce(debit, 0) - coalesce(credit, 0)) as double) as total,
       strftime(min(doc_date), '%Y-%m-%d') as first_day from statements_raw
union all select 'ledger', count(*), cast(sum(amount) as double), strftime(min(ts), '%Y-%m-%d') from ledger_raw
union all select 'journal', count(*), cast(sum(rate_usd) as double), strftime(min(strptime(date_text, '%d.%m.%Y')), '%Y-%m-%d') from journal_raw
""")
add("q02_load_override", """
select 'statements' as source, count(*) as rows from statements_raw
union all select 'ledger', count(*) from ledger_raw where kind = 'payment' union all select 'journal', count(*) from journal_raw
""")
add("sink_tables", """
select 'groups' as table_name, count(*) as rows from verdicts union all select 'group_tickets', count(*) from g_tickets
union all select 'payment_exceptions', count(*) from exceptions union all select 'agent_actions', count(*) from actions
union all select 'agent_bridge', count(*) from bridge union all select 'monthly_bridge', count(*) from monthly
union all select 'statement_integrity', count(*) from acts union all select 'version_differences', count(*) from version_diff
union all select 'missing_months', count(*) from missing
union all select 'name_mapping', (select count(*) from folder_map) + (select count(*) from party_map)
union all select 'employee_risk', count(distinct employee) from jo where kind = 'sale' and agent not in ('DIRECT_CLIENT', 'UNASSIGNED')
union all select 'checks', 11
""")
add("sink_round_trip", f"""
select table_name, unnest(['parquet', 'json', 'csv']) as format, rows, true as same from ({PLAIN['sink_tables']})
""")
add("result_cache", """
select table_name, true as found, rows from (
    select 'groups' as table_name, count(*) as rows from verdicts union all select 'payment_exceptions', count(*) from exceptions
    union all select 'agent_actions', count(*) from actions union all select 'agent_bridge', count(*) from bridge
    union all select 'monthly_bridge', count(*) from monthly union all select 'statement_integrity', count(*) from acts
    union all select 'missing_months', count(*) from missing)
""")
add("q03_extract_tickets", f"""
select doc_id, array_to_string(t, '|') as tickets, cast(len(t) as bigint) as n from (select doc_id, {tickets('text')} as t from documents)
""")
add("q04_norm_text", """
select doc_id, trim(regexp_replace(replace(upper(replace(text, 'ß', 'SS')), 'Ё', 'Е'), '[^A-ZА-Я0-9]+', ' ', 'g')) as name from documents
""")
add("q05_parse_number", rf"""
select row_no, cast({number("token")} as double) as value from (select row_no, regexp_extract(replace(regexp_replace(upper(pay_cell), '\(.*?\)', ' ', 'g'),
       chr(160), ' '), '[-+]?[0-9][0-9 .,]*[0-9]|[-+]?[0-9]') as token from journal_raw where pay_cell is not null)
""")
add("q06_parse_amount", f"select row_no, {d('amount')} from jou")
add("q07_amount_issues", "select row_no, pay_cell, is_foreign, amount_issue, cast(round(amount, 4) as double) as amount from jou")
add("q06_document_amounts", f"""
with marked as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(upper(replace(text, 'ß', 'SS')), chr(160), ' '), '\\(.*?\\)', ' ', 'g'),
                    '\\s\\+\\s', chr(1), 'g'), '\\+(\\s*[A-ZА-Я$€0-9])', chr(1) || '\\1', 'g') as t from documents),
     parts as (select doc_id, unnest(string_split(t, chr(1))) as part from marked),
     n as (select doc_id, {number("regexp_extract(part, '[-+]?[0-9][0-9 .,]*[0-9]|[-+]?[0-9]')")} as v,
             case when contains(part, 'KGS') or contains(part, 'СОМ') then 1 when contains(part, 'USD') or contains(part, '$') then 2
                  when contains(part, 'EUR') or contains(part, '€') then 3 when contains(part, 'RUB') or contains(part, 'РУБ') then 4
                  when contains(part, 'KZT') or contains(part, 'ТГ') or contains(part, 'ТЕНГЕ') then 5 else 1 end as rate from parts)
select doc_id, cast(sum(try_cast(v as decimal(24,8)) * rate) as double) as amount from n group by doc_id
""")
add("q08_digit_pattern", f"select gid, {d('statement_sum', 'ledger_sum')}, {digit_pattern('statement_sum', 'ledger_sum')} as pattern from g0")
add("q09_document_kind", "select line_kind, count(*) as rows, cast(sum(mv) as double) as mv from st_rows group by line_kind")
add("q10_journal_agrees", """
select gid, abs(journal_sum - statement_sum) <= case when journal_foreign then greatest(5, 0.005 * abs(statement_sum)) else 5 end as like_statement,
       abs(journal_sum + ledger_sum) <= case when journal_foreign then greatest(5, 0.005 * abs(ledger_sum)) else 5 end as like_ledger
from g0 where journal_sum is not null
""")
add("q11_month_missing", """
select l.agent, count(f.month) as flagged, count(*) as rows from led l left join flagged f
on f.agent = l.agent and f.month = cast(date_trunc('month', l.ts) as date) group by l.agent
""")
add("date_parts", """
select txn_id, cast(hour(ts) as bigint) as hour, cast(isodow(ts) - 1 as bigint) as weekday, cast(day(ts) as bigint) as dom,
       cast(day(ts) >= 28 as bigint) as month_end, month from led
""")
add("tolerant_casts", r"""
with w as (select doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word from documents),
     c as (select doc_id,
             case when regexp_full_match(word, '[-+]?[0-9]+') then try_cast(word as bigint) end as whole,
             case when regexp_full_match(word, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,3})?') then try_cast(word as decimal(18,2)) end as number,
             case when regexp_full_match(word, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(word, '%Y-%m-%d') end as day from w)
select doc_id, count(*) as words, count(whole) as wholes, count(number) as numbers, coalesce(sum(number), 0)::double as total, count(day) as days
from c group by doc_id
""")
add("money_text", f"select txn_id, {money('amount', True)} as signed, round(ln(1 + abs(cast(amount as double))), 6) as log_amount from led")
def spelled(column: str, names: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {column} end"


add("labels_lookup", f"""
select status, {spelled('status', STATUS_LABELS)} as status_label, {spelled('error_source', SOURCE_LABELS)} as source_label, count(*) as groups
from verdicts group by status, error_source
""")
add("q12_latest_statements", f"select folder, {day('period_start')}, version, line_no, {d('mv')} from st_latest")
add("q13_version_differences", "select * from version_diff")
add("q14_ledger_rows", f"""
select agent, txn_id, {ts('ts')}, {day('day')}, month, {d('amount', 'balance_after')}, {joined('tickets')},
       row_number() over (partition by agent order by led.ts, txn_id) as agent_row from led
""")
add("q15_exact_duplicates", f"select row_no, party, is_copy, {day('day')}, {joined('tickets')} from jou")
add("q59_duplicated", "select party, count(*) filter (where is_copy) as copies, count(*) as rows from jou group by party")
add("window_filter", """
select l.agent, kind, coalesce(day >= window_start and day <= window_end, false) as in_window, count(*) as rows, cast(sum(amount) as double) as amount
from led l left join windows w on w.agent = l.agent group by 1, 2, 3
""")
GROUP_HEAD = f"""
gid, agent, tickets, ticket_count, {d('statement_sum')}, statement_rows, {day('statement_first', 'statement_last')}, {d('ledger_sum')},
ledger_rows, {ts('ledger_first', 'ledger_last')}, ledger_kinds, ledger_creators, by_bot, has_void, has_refund, {d('journal_sum')},
journal_rows, journal_unread, journal_foreign, journal_kinds, employees, journal_issue, journal_copies, {d('extra_amount')}, {n('extra_rows')}, {d('residual')}
"""
add("q16_group_totals", f"select {GROUP_HEAD} from g0")
add("q17_lookup", "select agent, folder, count(*) as rows, cast(sum(mv) as double) as mv from st group by agent, folder")

LABELLED = """
with p as (select txn_id, error_source from exceptions where found_in = 'LEDGER'),
     s as (select l.*, case when kind = 'payment' then coalesce(p.error_source, 'OK') else v.error_source end as src
           from led_g l left join p using (txn_id) left join (select gid, error_source from verdicts) v on v.gid = l.gid)
select *, case when src in ('OK', 'BOT', 'STATEMENT', 'AGENT', 'REVIEW') then src else 'REVIEW' end as label,
       case when src = 'OK' then 0 else 1 end as is_err from s where src <> 'EXPORT'
"""
import oracle.engine as _engine  # noqa: E402

_engine.CTES["lab"] = LABELLED
_engine.CTES["history"] = """
with m as (select agent, month, sum(is_err) as e, count(*) as c from lab group by agent, month)
select agent, month, (coalesce(sum(e) over w, 0) + 1) / (coalesce(sum(c) over w, 0) + 20) as prior_error_rate,
       cast(coalesce(sum(c) over w, 0) as bigint) as prior_rows
from m window w as (partition by agent order by month rows between unbounded preceding and 1 preceding)
"""
_engine.CTES["reg_emp"] = """
select agent, ticket, arg_min(employee, row_no) as employee from (select agent, employee, row_no, unnest(tickets) as ticket from jo_g) group by agent, ticket
"""
_engine.CTES["first_emp"] = """
select txn_id, arg_min(e.employee, pos) as employee
from (select txn_id, agent, unnest(tickets) as ticket, generate_subscripts(tickets, 1) as pos from led_g) t join reg_emp e using (agent, ticket) group by txn_id
"""
_engine.CTES["feats"] = """
with a as (select agent, count(distinct agreement_id) as agreements from led_g group by agent)
select l.*, coalesce(f.employee, 'none') as employee, a.agreements, h.prior_error_rate, h.prior_rows,
       case when len(tickets) > 0 then row_number() over (partition by l.agent, ticket_text order by ts, l.txn_id) - 1 else 0 end as prior_same_ticket,
       case when kind = 'payment' and l.agent is not null and amount is not null then coalesce(date_diff('microsecond', lag(ts) over (partition by kind = 'payment', l.agent, amount order by ts, l.txn_id), ts)
            / 3.6e9, 9999.0) else 9999.0 end as hours_since_same
from lab l left join first_emp f using (txn_id) left join a on a.agent = l.agent left join history h on h.agent = l.agent and h.month = l.month
"""
add("q18_merge_history", "select txn_id, l.agent, l.month, round(h.prior_error_rate, 9) as prior_error_rate, h.prior_rows from lab l join history h on h.agent = l.agent and h.month = l.month")
add("q19_merge_counts", f"select agent, {d('gap_close')}, {n('n_OK', 'n_AMOUNT_RESIDUAL', 'n_REPEATED_CREDIT', 'n_PAYMENT_NOT_IN_LEDGER')} from actions")
add("q20_unmatched_receipts", f"select agent, line_no, {day('doc_date')}, doc, {d('amount')} from rec_open")
add("q21_band_join", """
select p.txn_id as id, count(*) as candidates, cast(min(abs(datediff('day', p.day, r.doc_date))) as bigint) as nearest
from pay p join rec r on p.agent = r.agent and abs(p.amount - r.amount) <= 1 and abs(datediff('day', p.day, r.doc_date)) <= 7 group by p.txn_id
""")
add("q22_cross_agent_band_join", """
select r.line_no as id, count(*) as candidates, cast(min(abs(datediff('day', p.day, r.doc_date))) as bigint) as nearest
from rec_open r join pay_open p on p.agent <> r.agent and abs(p.amount - r.amount) <= 1 and abs(datediff('day', p.day, r.doc_date)) <= 10
where p.status <> 'REPEATED_CREDIT' group by r.line_no
""")
add("q23_balance_points", """
select b.agent, strftime(b.boundary, '%Y-%m-%d') as boundary, cast(coalesce(max(o.opening_balance), 0) + coalesce(sum(l.amount), 0) as double) as balance
from (select agent, period_start as boundary from acts union select agent, period_end + 1 from acts) b
left join opens o using (agent) left join led l on l.agent = b.agent and l.ts < b.boundary group by b.agent, b.boundary
""")
add("q24_first_employee", "select * from first_emp")
add("q25_ticket_owners", "select ticket, agent from owners")
add("q26_ticket_conflicts", "select cast(sum(conflicts) as bigint) as conflicts, count(*) as tickets from owners")
add("q27_folder_votes", "select folder, agent, cast(shared_tickets as bigint) as shared_tickets, round(confidence, 9) as confidence from folder_map")
add("q28_all_ticket_owners", "select ticket, agent from t2a")
add("q29_party_votes", "select party, agent, shared_tickets, round(confidence, 9) as confidence, confidence >= 0.9 as accepted from party_map")
add("q30_name_evidence", """
select 'statements' as source, folder as name_in_source, agent, cast(shared_tickets as bigint) as shared_tickets, round(confidence, 9) as confidence from folder_map
union all select 'journal', party, agent, shared_tickets, round(confidence, 9) from party_map
""")
add("q31_journal_agents", "select row_no, party, agent from jo")
add("q32_components", "select node, root from roots")
add("group_numbers", """
with r as (select gid, cast(row_number() over (order by gid) - 1 as varchar) as i from verdicts)
select gid, 'G' || lpad(i, cast(greatest(5, length(i)) as integer), '0') as group_id from r
""")
add("q33_statement_aggregate", f"""
select gid, {d('statement_sum')}, statement_rows, {day('statement_first', 'statement_last')}, statement_docs from g0 where statement_rows > 0
""")
add("q34_ledger_aggregate", f"""
select gid, {d('ledger_sum')}, ledger_rows, {ts('ledger_first', 'ledger_last')}, ledger_kinds, ledger_creators, by_bot, has_void, has_refund, ledger_txns
from g0 where ledger_rows > 0
""")
add("q35_repeated_debits", f"select gid, {d('extra_amount')}, {n('extra_rows')} from g_dup")
add("q36_journal_aggregate", """
select gid, cast(round(journal_sum, 4) as double) as journal_sum, journal_rows, journal_unread, journal_foreign, journal_kinds, employees,
       journal_issue, journal_copies from g0 where journal_rows + journal_copies > 0
""")
add("q37_group_tickets", "select gid, agent, ticket from g_tickets")
add("q38_residuals", f"select gid, agent, tickets, ticket_count, {d('residual')} from g0")
add("q39_statement_table", f"select agent, {day('period_start', 'period_end')}, {d('opening', 'closing', 'mv')}, rows, version from acts")
add("q40_value_counts", """
select status, count(*) as n from verdicts group by status union all select status, count(*) from exceptions group by status
union all select 'label ' || label, count(*) from lab group by label
""")
add("q41_status_pivot", f"select agent, {n(*[f'n_{s}' for s in GROUP_STATUSES])} from group_counts")
add("q42_distinct_agreements", "select agent, count(distinct agreement_id) as agreements from led_g group by agent")
add("q43_agent_risk", """
select agent, count(*) as operations, round(sum(txn_id % 97 / 97.0), 6) as expected_errors, round(avg(txn_id % 97 / 97.0), 6) as mean_p_error,
       cast(sum(is_err) as bigint) as flagged, cast(coalesce(sum(abs(amount)) filter (where txn_id % 97 / 97.0 > 0.1), 0) as double) as risky_turnover
from lab group by agent
""")
add("q44_lag_quantiles", "select quantile_cont(lag_days, 0.5) as median, quantile_cont(lag_days, 0.95) as p95 from verdicts where status = 'OK'")

add("q44_sketched_quantiles", "select unnest([0.5, 0.95])::double as share, count(l_extendedprice) as n, true as within from lineitem")
add("q71_saved_model", "select unnest(['forest', 'boosting']) as learner, 0::bigint as different")

_HEAD = [
    ("abs_ledger_adjust", "sum(abs(ledger_adjust)) from actions"), ("abs_statement_adjust", "sum(abs(statement_adjust)) from actions"),
    ("abs_to_clarify", "sum(abs(to_clarify)) from actions"), ("ledger_rows", "count(*) from led_in"), ("statement_rows", "count(*) from st"),
    ("journal_rows", "count(*) from jo"), ("groups", "count(*) from verdicts"),
    ("groups_in_both", "count(*) from verdicts where statement_rows > 0 and ledger_rows > 0"),
    ("matched_share", "avg(case when abs(residual) <= 5 then 1.0 else 0.0 end) from verdicts where statement_rows > 0 and ledger_rows > 0"),
    ("amount_residual", "count(*) from verdicts where status = 'AMOUNT_RESIDUAL'"),
    ("residual_statement_confirmed", "count(*) from verdicts where status = 'AMOUNT_RESIDUAL' and error_source = 'STATEMENT' and confidence = 'A'"),
    ("residual_bot_confirmed", "count(*) from verdicts where status = 'AMOUNT_RESIDUAL' and error_source = 'BOT' and confidence = 'A'"),
    ("residual_typing_error", "count(*) from verdicts where status = 'AMOUNT_RESIDUAL' and error_source = 'STATEMENT' and confidence = 'B'"),
    ("residual_undecided", "count(*) from verdicts where status = 'AMOUNT_RESIDUAL' and error_source = 'REVIEW'"),
    *[(s.lower(), f"count(*) from verdicts where status = '{s}'") for s in (
        "DOUBLE_DEBIT", "STATEMENT_ONLY_JOURNAL_SALE", "NOT_IN_STATEMENT", "LEDGER_IN_MISSING_MONTH", "DIRECT_CLIENT", "JOURNAL_DUPLICATE",
        "JOURNAL_ONLY_SALE")],
    ("ok_lag_median", "quantile_cont(lag_days, 0.5) from verdicts where status = 'OK'"),
    ("ok_lag_95", "quantile_cont(lag_days, 0.95) from verdicts where status = 'OK'"),
    ("payment_not_in_ledger", "count(*) from exceptions where status = 'PAYMENT_NOT_IN_LEDGER'"),
    ("payment_not_in_ledger_amount", "coalesce(-sum(gap_effect), 0) from exceptions where status = 'PAYMENT_NOT_IN_LEDGER'"),
    ("repeated_credit", "count(*) from exceptions where status = 'REPEATED_CREDIT'"),
    ("continuity_breaks", "count(*) from acts where continuity_break"),
    ("continuity_break_amount", "coalesce(sum(abs(jump)), 0) from acts where continuity_break"),
    ("statement_arithmetic_errors", "count(*) from acts where abs(internal_delta) > 0.02"),
    ("missing_agent_months", "count(*) from missing"), ("ledger_chain_breaks", "count(*) from breaks"),
    ("agents_with_opening_gap", "count(*) from bridge where abs(opening_gap) > 5"), ("opening_gap_net", "sum(opening_gap) from bridge"),
]
_CHECKS = [
    ("ticket_agent_conflicts", "sum(conflicts) from owners"),
    ("ledger_rows_outside_window", "count(*) - (select count(*) from led_in) from led"),
    ("ledger_rows_without_ticket", "count(*) from led_in where len(tickets) = 0 and kind <> 'payment'"),
    ("ledger_chain_breaks", "count(*) from breaks"), ("ledger_chain_break_agents", "count(distinct agent) from breaks"),
    ("ledger_chain_total_mismatches", "count(*) from opens where abs(chain_check) > 1"),
    ("statement_rows_without_ticket", "count(*) from st where len(tickets) = 0 and line_kind <> 'receipt'"),
    ("journal_rows_unassigned", "count(*) from jo where agent = 'UNASSIGNED'"),
    ("bridge_max_unexplained", "max(abs(unexplained)) from bridge"), ("monthly_identity_max", "max(abs(identity_residual)) from monthly"),
    ("actions_max_check", "max(abs(check_after_fixes)) from actions"),
]


def measures(rows, key: str) -> str:
    return " union all ".join(
        f"select '{name}' as {key}, round(cast(v as double), 6) as value from (select {body.replace(' from ', ' as v from ', 1)})"
        if " - (select" not in body else
        f"select '{name}' as {key}, round(cast(v as double), 6) as value from (select (select count(*) from led) - (select count(*) from led_in) as v)"
        for name, body in rows)


add("q45_headline", measures(_HEAD, "measure"))
add("q66_checks", measures(_CHECKS, '"check"'))
add("summary_table", f"""
select 'checks' as section, k as key, value from ({measures(_CHECKS, 'k')})
union all select 'status', status, cast(count(*) as double) from verdicts group by status
union all select 'payments', status, cast(count(*) as double) from exceptions group by status
union all select 'headline', k, value from ({measures(_HEAD, 'k')})
""")


def totals(columns, source: str) -> str:
    body = ", ".join(f"cast(sum({c}) as double) as {c}" for c in columns)
    return f"select agent, {body} from {source} group by agent union all select 'TOTAL', {body} from {source}"


add("q46_totals", totals(("gap_close", "opening_gap", "unexplained"), "bridge"))
add("q47_dense_matching", "select proposer, seat from dense_pairs")
add("q47_payment_matches", "select proposer as txn_id, seat as matched_line from near_pairs")
add("q48_hours_since_same", """
select txn_id, case when agent is not null and amount is not null then
       round(date_diff('microsecond', lag(ts) over (partition by agent, amount order by ts, txn_id), ts) / 3.6e9, 6) end as hours_since_same from pay
""")
add("q48_null_amounts", """
with p as (select agent, txn_id, ts, case when txn_id % 7 = 0 then null else amount end as amount from pay)
select txn_id, case when amount is not null then
       round(date_diff('microsecond', lag(ts) over (partition by agent, amount order by ts, txn_id), ts) / 3.6e9, 6) end as hours_since_same from p
""")
add("q49_unmatched_payments", f"select agent, txn_id, {d('amount')}, status from pay_open")
add("q50_wrong_agent", f"select agent, found_in, reference, {d('amount', 'gap_effect')} from exceptions where status = 'PAYMENT_WRONG_AGENT'")
add("q51_payment_exceptions", f"""
select agent, {ts('ts')}, found_in, reference, txn_id, {d('amount')}, status, error_source, confidence, explanation, fix_side, {d('gap_effect')} from exceptions
""")
add("q52_chain_breaks", f"""
select agent, {ts('ts')}, txn_id, {d('amount', 'balance_after', 'previous_balance')}, cast(balance_after - previous_balance - amount as double) as chain_gap from breaks
""")
add("q52_chain_totals", f"select agent, {d('opening_balance', 'moved', 'last_balance', 'chain_check')} from opens")
add("q53_statement_continuity", f"""
select agent, {day('period_start', 'period_end')}, {d('opening', 'closing', 'mv')}, rows, version, folder, {d('internal_delta', 'previous_closing')},
       {day('previous_end')}, {d('jump')}, consecutive, continuity_break, jump_over_missing from acts
""")
add("q54_missing_months", f"select agent, {day('month')} from missing")
add("q54_agent_windows", f"select agent, {day('window_start', 'window_end')} from windows")
add("q55_best_version", f"select folder, {day('period_start')}, cast(max(version_rank) as bigint) as best from st_rows s group by folder, s.period_start")
add("q56_prior_same_ticket", "select txn_id, prior_same_ticket from feats")
add("q57_hours_since_payment", "select txn_id, round(hours_since_same, 6) as hours_since_same from feats")
add("q58_error_history", "select agent, month, round(prior_error_rate, 9) as prior_error_rate, prior_rows from history")
add("ordered_scan_null_keys", """
with e as (select event_id, case when event_id % 5 = 0 then null else user_id % 3 end as key, ts, value from events)
select event_id, key, row_number() over w as n, cast(sum(cast(value as decimal(18,2))) over w as double) as running,
       date_diff('microsecond', lag(ts) over w, ts) as gap_micros
from e window w as (partition by key order by ts, event_id)
""")
add("chain_on_events", """
select event_id, user_id, row_number() over w as n, cast(sum(cast(value as decimal(18,2))) over w as double) as running,
       date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) as gap_micros
from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)
""")
add("q60_classify", f"select gid, agent, {n('rule')}, status, error_source, confidence, fix_side, {d('gap_effect')}, amount_pattern, {n('lag_days')} from verdicts")
add("q61_monthly_identity", f"""
select agent, month, {d('opening', 'closing', 'statement_moved', 'internal_delta', 'ledger_start', 'ledger_end', 'ledger_moved', 'gap_start', 'gap_end',
       'gap_change', 'identity_expected', 'identity_residual', 'opening_jump')}, continuity_break from monthly
""")
add("q62_agent_bridge", f"select agent, {day('window_start', 'window_end')}, {d('gap_close', *COMPONENTS, 'components_sum', 'unexplained')} from bridge")
_COUNTS = [f"n_{s}" for s in GROUP_STATUSES + _engine.PAYMENT_STATUSES]
add("q64_agent_actions", f"""
select agent, {day('window_start', 'window_end')}, {d('gap_close', *COMPONENTS, 'components_sum', 'unexplained', 'ledger_adjust', 'statement_adjust',
       'to_clarify', 'gap_after_fixes', 'check_after_fixes', 'priority')}, {n(*_COUNTS, 'missing_months')}, status from actions
""")
add("q65_recommendations", "select agent, recommended_action from actions")
add("q67_labels", "select txn_id, label, cast(is_err as bigint) as is_err from lab")
add("q68_features", f"""
select txn_id, agent, month, {ts('ts')}, {d('amount')}, kind, creator, currency, employee, round(ln(1 + abs(cast(feats.amount as double))), 6) as log_amount,
       cast(hour(feats.ts) as bigint) as hour, cast(isodow(feats.ts) - 1 as bigint) as weekday, cast(day(feats.ts) as bigint) as dom,
       cast(day(feats.ts) >= 28 as bigint) as month_end, cast(len(tickets) as bigint) as n_tickets, agreements, prior_same_ticket,
       round(hours_since_same, 6) as hours_since_same, round(prior_error_rate, 9) as prior_error_rate, prior_rows from feats
""")
add("q69_balanced_weights", """
with c as (select label, count(*) as class_rows from lab group by label)
select label, class_rows, round(sqrt(sum(class_rows) over () / (count(*) over () * class_rows)), 9) as weight from c
""")

_engine.CTES["judged"] = """
select l.doc_id, 1 - quality as bad, cast(n_chars % 50 as double) as score, n_chars / 100.0 as length, source,
       case when quality = 1 and toxic = 0 then case when l.doc_id % 11 = 0 then 'AGENT' else 'OK' end when toxic = 1 then 'BOT' else 'REVIEW' end as label,
       ['OK', 'OK', 'BOT', 'STATEMENT', 'AGENT'][n_chars % 5 + 1] as guess
from labels l join documents using (doc_id)
"""
_engine.CTES["classwise"] = """
with c as (select unnest(['OK', 'BOT', 'STATEMENT', 'AGENT', 'REVIEW']) as class, unnest([0, 1, 2, 3, 4]) as position),
     a as (select class, position, (select count(*) from judged where label = class) as support, (select count(*) from judged where guess = class) as guesses,
             (select count(*) from judged where label = class and guess = class) as hits from c),
     p as (select *, case when guesses > 0 then hits / guesses else 0.0 end as precision, case when support > 0 then hits / support else 0.0 end as recall from a)
select class, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1, support, position from p
"""
add("q73_class_metrics", """
select class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support, cast(position as bigint) as position from classwise
""")
add("q73_class_summary", """
with b as (select count(*) as n_test, avg(case when label = guess then 1.0 else 0.0 end) as accuracy, avg(case when label = 'OK' then 1.0 else 0.0 end) as p from judged)
select n_test, round(accuracy, 9) as accuracy, round(p, 9) as accuracy_majority, round((select avg(f1) from classwise), 9) as macro_f1,
       round(2 * p / (p + 1) / 5, 9) as macro_f1_majority, round((select avg(recall) from classwise where support > 0), 9) as balanced_accuracy from b
""")


def ap(score: str) -> str:
    return f"""(with s as (select {score} as s, count(*) as c, sum(bad) as p from judged group by 1),
      r as (select p, sum(p) over w as tp, sum(c) over w as total from s window w as (order by s desc rows unbounded preceding))
      select sum(p * tp / total) / sum(p) from r)"""


add("q74_average_precision", f"select round({ap('score')}, 9) as average_precision")
add("q75_roc_auc", """
select round(sum(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0.0 end) / count(*), 9) as roc_auc
from judged p join judged q on p.bad = 1 and q.bad = 0
""")
add("q76_top_share", """
with r as (select *, row_number() over (order by score desc, doc_id) as rk, count(*) over () as total from judged),
     t as (select *, rk <= greatest(1, cast(floor(total * 0.05) as bigint)) as top from r)
select count(*) filter (where top) as k, round(avg(bad) filter (where top), 9) as precision_at_top,
       round(avg(bad) filter (where top) / avg(bad), 9) as lift_at_top, round(sum(bad) filter (where top) / sum(bad), 9) as recall_at_top from t
""")
add("q77_baseline", f"select round({ap('length')}, 9) as baseline, round(avg(bad), 9) as random from judged")
add("q72_given_predictions", f"""
select s.*, round({ap('score')}, 9) as pr_auc, round({ap('length')}, 9) as pr_auc_prior_rate,
       (select round(avg(bad), 9) from judged) as test_error_rate, a.*, t.* exclude k
from ({PLAIN['q73_class_summary']}) s, ({PLAIN['q75_roc_auc']}) a, ({PLAIN['q76_top_share']}) t
""")
add("q78_given_scores", """
with a as (select doc_id, bad, score, floor(length) as length, doc_id % 13 as digit, row_number() over (order by doc_id) as place from judged),
     b as (select score, length, digit, row_number() over (order by md5('7|' || doc_id), doc_id) as place from a),
     v as (select unnest(['', 'score', 'length', 'digit']) as feature, bad, a.score + a.length + 2 * a.digit as base, a.score, a.length, a.digit,
                  unnest([a.score + a.length + 2 * a.digit, b.score + a.length + 2 * a.digit, a.score + b.length + 2 * a.digit,
                          a.score + a.length + 2 * b.digit]) as s from a join b using (place)),
     tied as (select feature, s, count(*) as c, sum(bad) as p from v group by all),
     run as (select feature, p, sum(p) over w as tp, sum(c) over w as total from tied window w as (partition by feature order by s desc rows unbounded preceding)),
     ap as (select feature, sum(p * tp / total) / sum(p) as ap from run group by feature)
select feature, round((select ap from ap where feature = '') - ap, 9) as pr_auc_drop from ap where feature <> ''
""")
add("q78_shuffled_column", """
with a as (select doc_id, bad, row_number() over (order by doc_id) as place from judged),
     b as (select score, row_number() over (order by md5('7|' || doc_id), doc_id) as place from judged)
select doc_id, score, cast(bad as bigint) as bad from a join b using (place)
""")
add("q70_category_codes", " union all ".join(
    f"select '{c}' as \"column\", {c} as value, row_number() over (order by {c}) - 1 as code from (select distinct {c} from feats where {c} is not null)"
    for c in ("kind", "creator", "currency", "employee")))
WILSON = """
round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9)
"""
HIGH = WILSON.replace(" - 1.96 * sqrt", " + 1.96 * sqrt")
add("q79_wilson", f"""
select source, cast(k as bigint) as k, cast(n as bigint) as n, {WILSON} as low, {HIGH} as high
from (select source, cast(sum(bad) as double) as k, cast(count(*) as double) as n from judged group by source)
""")
_engine.CTES["emp"] = """
select employee, cast(count(*) filter (where coalesce(status in ('JOURNAL_AMOUNT_DIFF', 'TICKET_IN_AMOUNT'), false) or amount_issue <> '' or is_copy) as double) as k,
       cast(count(*) as double) as n
from jo_g j left join (select gid, status from verdicts) v on v.gid = j.gid
where kind = 'sale' and j.agent not in ('DIRECT_CLIENT', 'UNASSIGNED') group by employee
"""
add("q80_employee_risk", f"""
select employee, cast(k as bigint) as errors, cast(n as bigint) as rows, round(k / n, 9) as error_rate, {WILSON} as ci95_low, {HIGH} as ci95_high from emp
""")
add("q81_chi_square", """
with t as (select sum(k) as tk, sum(n) as tn from emp)
select round(sum(power(k - n * tk / tn, 2) / (n * tk / tn) + power(n - k - n * (1 - tk / tn), 2) / (n * (1 - tk / tn))), 9) as statistic, count(*) - 1 as dof
from emp, t
""")
add("q81_significance", """
with t as (select sum(k) as tk, sum(n) as tn from emp),
     x as (select sum(power(k - n * tk / tn, 2) / (n * tk / tn) + power(n - k - n * (1 - tk / tn), 2) / (n * (1 - tk / tn))) / 2 as half, count(*) - 1 as dof from emp, t),
     p as (select exp(-half) * list_sum(list_transform(range(0, dof // 2), lambda i: power(half, i) / gamma(i + 1))) as p from x where dof % 2 = 0)
select employee, round(p, 9) as chi2_p_value, p < 0.05 as significant from emp, p
""")
add("q82_agent_balances", """
with c as (select agent, arg_max(closing, (period_start, period_end)) as sc from acts group by agent)
select agent, cast(sc as double) as statement_closing, cast(gap_close - sc as double) as ledger_closing, cast(gap_close as double) as gap,
       cast(ledger_adjust as double) as ledger_adjust, cast(statement_adjust as double) as statement_adjust, cast(rounding as double) as journal_errors,
       cast(to_clarify as double) as to_clarify, cast(gap_close - to_clarify - unexplained as double) as explained, cast(unexplained as double) as unexplained,
       case when abs(priority) < 1 then 'Settled' else 'Needs attention' end as verdict, recommended_action as recommendation
from actions join c using (agent)
""")
STATUS_LABEL, SOURCE_LABEL, OWNER = spelled("status", STATUS_LABELS), spelled("error_source", SOURCE_LABELS), spelled("error_source", SOURCE_OWNERS)
add("q83_discrepancies", f"""
with g as (select *, coalesce(cast(statement_first as timestamp), ledger_first) as seen from verdicts
           where status not in ('OK', 'VOID_CLOSED', 'DIRECT_CLIENT', 'TICKET_IN_AMOUNT', 'JOURNAL_DUPLICATE'))
select agent, coalesce(strftime(seen, '%Y-%m-%d'), '-') as date, coalesce(strftime(seen, '%Y-%m'), '-') as period, tickets as ticket,
       cast(abs(case when gap_effect <> 0 then gap_effect else residual end) as double) as amount, {SOURCE_LABEL} as source, {STATUS_LABEL} as error_type,
       case when employees = '' then '-' else employees end as employee, case when ledger_txns <> '' then ledger_txns else gid end as reference from g
union all
select agent, strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m'), '-', cast(abs(amount) as double), {SOURCE_LABEL}, {STATUS_LABEL}, '-', reference from exceptions
""")
add("q83_group_sheet", f"""
select gid, agent, tickets, {STATUS_LABEL} as error_type, {SOURCE_LABEL} as source, confidence, {d('statement_sum', 'ledger_sum')},
       cast(cast(journal_sum as decimal(18,2)) as double) as journal_sum, {d('residual')}, {ts('ledger_first')}, {day('statement_first')}, amount_pattern,
       {OWNER} as who_checks,
       employees, ledger_txns from verdicts where status not in ('OK', 'VOID_CLOSED', 'DIRECT_CLIENT')
""")
add("q83_payment_sheet", f"""
select agent, {ts('ts')}, found_in, reference, {d('amount')}, status, {SOURCE_LABEL} as source, confidence, explanation, {d('gap_effect')} from exceptions
""")
add("q84_anomalies", """
with g as (select *, coalesce(ledger_first, cast(statement_first as timestamp)) as seen from verdicts)
select agent, strftime(seen, '%Y-%m-%d') as date, tickets as ticket, 'Ticket debited twice' as anomaly, 'high' as severity, cast(abs(extra_amount) as double) as amount
from g where status = 'DOUBLE_DEBIT'
union all select agent, strftime(ts, '%Y-%m-%d'), '-', 'Payment credited again', 'critical', cast(abs(amount) as double) from exceptions where status = 'REPEATED_CREDIT'
union all select agent, strftime(ts, '%Y-%m-%d'), '-', 'Payment to another agent', 'high', cast(abs(amount) as double) from exceptions where status = 'PAYMENT_WRONG_AGENT'
union all select agent, strftime(seen, '%Y-%m-%d'), tickets, 'Void without full return', 'medium', cast(abs(ledger_sum) as double) from g where status = 'VOID_UNBALANCED'
union all select agent, strftime(period_start, '%Y-%m-%d'), '-', 'Balance jump between statements',
       case when abs(jump) > 50000 then 'critical' else 'high' end, cast(abs(jump) as double) from acts where continuity_break
""")
add("q85_risk_ranking", """
with a as (select agent, count(*) as operations, avg(txn_id % 97 / 97.0) as p, cast(sum(is_err) as bigint) as flagged,
             cast(coalesce(sum(abs(amount)) filter (where txn_id % 97 / 97.0 > 0.1), 0) as double) as risky_turnover from lab group by agent)
select row_number() over (order by p desc, agent) as risk_rank, agent, operations, round(p, 4) as mean_p_error, flagged, risky_turnover from a
""")
_BAD = "status not in ('OK', 'VOID_CLOSED', 'DIRECT_CLIENT', 'TICKET_IN_AMOUNT', 'JOURNAL_DUPLICATE')"
add("q86_kpi_card", f"""
select 'matched_operations' as name, (select cast(sum(ledger_rows) as double) from verdicts where not ({_BAD})) as value
union all select 'groups_ok', (select cast(count(*) as double) from verdicts where status = 'OK')
union all select 'discrepancies', (select cast(count(*) as double) from verdicts where {_BAD}) + (select count(*) from exceptions)
union all select 'ledger_adjust', (select cast(sum(abs(ledger_adjust)) as double) from actions)
union all select 'statement_adjust', (select cast(sum(abs(statement_adjust)) as double) from actions)
union all select 'anomalies', (select cast(count(*) as double) from verdicts where status in ('DOUBLE_DEBIT', 'VOID_UNBALANCED'))
   + (select count(*) from exceptions where status in ('REPEATED_CREDIT', 'PAYMENT_WRONG_AGENT')) + (select count(*) from acts where continuity_break)
union all select 'roc_auc', null
""")
add("q86_kpi_quality", """
with p as (select is_err, txn_id % 97 / 97.0 as s from lab), r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as place from p)
select 'roc_auc' as name, round((sum(place) filter (is_err = 1) - sum(is_err) * (sum(is_err) + 1) / 2.0) / (sum(is_err) * (count(*) - sum(is_err))), 9) as value from r
""")
add("q87_bridge_sheet", totals(("gap_close", *COMPONENTS, "components_sum", "unexplained"), "bridge"))
_PROBLEMS = " + ".join(c for c in _COUNTS if c not in ("n_OK", "n_VOID_CLOSED", "n_DIRECT_CLIENT"))
_SHEET = ("opening_gap", "gap_close", "ledger_adjust", "statement_adjust", "to_clarify", "rounding", "unexplained")
_sheet = f"""{", ".join(f"cast(sum({c}) as double) as {c}" for c in _SHEET)}, cast(sum({_PROBLEMS}) as bigint) as problems,
 cast(sum(missing_months) as bigint) as missing_months, cast(sum(gap_close + ledger_adjust + statement_adjust) as double) as left_after_fixes,
 cast(sum(gap_close + ledger_adjust + statement_adjust - to_clarify - rounding - unexplained) as double) as "check" """
add("q87_agent_sheet", f"select agent, {_sheet} from actions group by agent union all select 'TOTAL', {_sheet} from actions")
add("q88_break_list", f"""
select agent, strftime(period_start, '%Y-%m') as period, {d('previous_closing', 'opening', 'jump')},
       case when continuity_break then 'consecutive months' else 'over a missing month' end as kind from acts where continuity_break or jump_over_missing
""")
add("q89_transposed_metrics", " union all ".join(
    f"select '{m}' as metric, " + ", ".join(
        f"(select round(cast({m} as double), 9) from classwise where class = '{c}') as {c}" for c in ("OK", "BOT", "STATEMENT", "AGENT", "REVIEW"))
    for m in ("precision", "recall", "f1", "support")))
add("q90_exemplars", """
select * from (select 'wrong statement amount' as "case", agent, cast(residual as double) as amount, tickets as what from verdicts
  where status = 'AMOUNT_RESIDUAL' and error_source = 'STATEMENT' and confidence = 'A' and journal_rows > 0 and ticket_count = 1
  order by abs(residual) desc, gid desc limit 1)
union all select * from (select 'ticket debited twice', agent, cast(extra_amount as double), tickets from verdicts where status = 'DOUBLE_DEBIT'
  order by abs(extra_amount) desc, gid desc limit 1)
union all select * from (select 'payment credited again', agent, cast(amount as double), reference from exceptions where status = 'REPEATED_CREDIT'
  order by abs(amount) desc, reference desc limit 1)
""")

for _forced, _usual in {"forced_components": "q32_components", "forced_votes": "q28_all_ticket_owners", "forced_groups": "q16_group_totals",
                        "forced_payments": "q51_payment_exceptions", "forced_bridge": "q62_agent_bridge"}.items():
    ORACLE[_forced] = ORACLE[_usual]
