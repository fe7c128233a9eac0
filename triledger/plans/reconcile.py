"""The whole reconciliation, from three raw tables to bridge and actions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from triledger.config import DEFAULT, Config
from triledger.operators import bridge as bridge_ops
from triledger.operators import ledger as ledger_ops
from triledger.operators import payments as payment_ops
from triledger.operators import prepare, risk, voting
from triledger.operators.checks import integrity_checks
from triledger.operators.components import connected_components, ticket_edges, with_group
from triledger.operators.durable import bounded, durable, known_rows, side_by_side
from triledger.operators.features import build_features
from triledger.operators.groups import build_groups, group_tickets
from triledger.operators.skew import SMALL_LOOKUP
from triledger.plans.classify import classify_groups
from triledger.sources.derived import Sources

# What later steps read of the rows that are shuffled whole; `statements`, `ledger_prepared` and `journal_prepared` have every column.
STATEMENT_COLUMNS = ("agent", "line_no", "line_kind", "doc", "doc_date", "mv", "tickets")
LEDGER_COLUMNS = (
    "agent", "agreement_id", "txn_id", "ts", "day", "month", "kind", "ticket_text", "amount", "currency", "creator", "tickets")
JOURNAL_COLUMNS = ("row_no", "party", "employee", "kind", "is_copy", "tickets", "amount", "is_foreign", "amount_issue")


def _only(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return bounded(rows.select(*columns), known_rows(rows))


@dataclass(frozen=True)
class Result:
    """Every table of a reconciliation.  A table is planned when it is first asked for.

    Tables that several others read are written once to the checkpoint folder, everything else
    stays lazy.
    """

    sources: Sources
    config: Config = DEFAULT

    def compute(self) -> Result:
        """Write the shared tables now, independent ones at the same time."""
        self._beside("groups", "payments", "acts")
        self.bridge
        return self

    def _beside(self, *names: str) -> None:
        """Make these tables at the same time, after all that they share."""
        for step in (
            ("statement_versions", "ledger_prepared", "journal_prepared"), ("latest",), ("votes",), ("statements", "journal_owned"),
            ("windows",), ("missing", "ledger_inside"), names,
        ):
            if any(name not in self.__dict__ for name in step):
                side_by_side(self.sources.ledger.sparkSession, *[lambda name=name: getattr(self, name) for name in step])

    # -- prepared sources -------------------------------------------------------------------
    @cached_property
    def statement_versions(self) -> DataFrame:
        return durable(prepare.statement_rows(self.sources.statements, self.config))

    @cached_property
    def latest(self) -> DataFrame:
        return prepare.latest_statements(self.statement_versions, self.config)

    @cached_property
    def versions(self) -> DataFrame:
        return prepare.version_differences(self.statement_versions, self.config)

    @cached_property
    def ledger_prepared(self) -> DataFrame:
        return durable(prepare.ledger_rows(self.sources.ledger))

    @cached_property
    def journal_prepared(self) -> DataFrame:
        return durable(prepare.journal_rows(self.sources.journal))

    # -- names ------------------------------------------------------------------------------
    @cached_property
    def votes(self) -> voting.Votes:
        return voting.resolve(self.latest, self.ledger_prepared, self.journal_prepared, self.config)

    @cached_property
    def mapping(self) -> DataFrame:
        return voting.evidence(self.votes)

    @cached_property
    def statements(self) -> DataFrame:
        return durable(voting.statement_agents(self.latest, self.votes, self.config))

    @cached_property
    def journal_owned(self) -> DataFrame:
        return durable(voting.journal_agents(_only(self.journal_prepared, JOURNAL_COLUMNS), self.votes, self.config))

    # -- periods ----------------------------------------------------------------------------
    @cached_property
    def windows(self) -> DataFrame:
        return durable(ledger_ops.agent_windows(self.statements))

    @cached_property
    def missing(self) -> DataFrame:
        return durable(ledger_ops.missing_months(self.statements, self.windows))

    @cached_property
    def ledger_all(self) -> DataFrame:
        return ledger_ops.with_window_flag(self.ledger_prepared, self.windows, self.config)

    @cached_property
    def ledger_inside(self) -> DataFrame:
        inside = self.ledger_all.filter("in_window").drop("in_window")
        # A filter by a broadcast lookup reads the stored rows again; any other join is stored.
        return bounded(inside, known_rows(self.ledger_prepared)) if known_rows(self.windows) <= SMALL_LOOKUP else durable(inside)

    # -- groups -----------------------------------------------------------------------------
    @cached_property
    def components(self) -> DataFrame:
        edges = ticket_edges(self.statements, self.ledger_inside, self.journal_owned)
        return durable(connected_components(edges, hot_rows=self.config.hot_rows))

    @cached_property
    def statements_grouped(self) -> DataFrame:
        return durable(with_group(_only(self.statements, STATEMENT_COLUMNS), self.components, self.config.hot_rows))

    @cached_property
    def ledger(self) -> DataFrame:
        return durable(with_group(_only(self.ledger_inside, LEDGER_COLUMNS), self.components, self.config.hot_rows))

    @cached_property
    def journal(self) -> DataFrame:
        return durable(with_group(self.journal_owned, self.components, self.config.hot_rows))

    @cached_property
    def group_tickets(self) -> DataFrame:
        return durable(group_tickets(self.statements_grouped, self.ledger, self.journal))

    @cached_property
    def group_totals(self) -> DataFrame:
        return build_groups(self.statements_grouped, self.ledger, self.journal, self.group_tickets, self.config)

    @cached_property
    def groups(self) -> DataFrame:
        return durable(classify_groups(
            self.group_totals, self.missing, self.config,
            at_most=known_rows(self.statements, self.ledger, self.journal)))

    # -- payments ---------------------------------------------------------------------------
    @property
    def _payment_rows(self) -> int | None:
        return known_rows(self.statements, self.ledger_inside)

    @cached_property
    def payment_match(self) -> payment_ops.PaymentMatch:
        return payment_ops.match_payments(
            payment_ops.payment_rows(self.ledger_inside, self.config),
            payment_ops.receipt_rows(self.statements), self.config, at_most=self._payment_rows)

    @cached_property
    def payments(self) -> DataFrame:
        return durable(payment_ops.payment_exceptions(
            self.payment_match, self.missing, self.config, at_most=self._payment_rows))

    # -- balances ---------------------------------------------------------------------------
    @cached_property
    def openings(self) -> DataFrame:
        return ledger_ops.opening_balances(self.ledger_prepared)

    @cached_property
    def chain_breaks(self) -> DataFrame:
        return ledger_ops.chain_breaks(self.ledger_prepared, self.config)

    @cached_property
    def acts(self) -> DataFrame:
        return durable(ledger_ops.act_table(self.statements, self.config))

    @cached_property
    def monthly(self) -> DataFrame:
        return ledger_ops.monthly_bridge(self.acts, self.ledger_prepared)

    @cached_property
    def bridge(self) -> DataFrame:
        self._beside("groups", "payments", "acts")
        return durable(bridge_ops.agent_bridge(self.acts, self.groups, self.payments, self.ledger_prepared))

    @cached_property
    def actions(self) -> DataFrame:
        return bridge_ops.agent_actions(self.bridge, self.groups, self.payments, self.missing)

    # -- people -----------------------------------------------------------------------------
    @cached_property
    def employee_risk(self) -> DataFrame:
        errors = risk.journal_errors(self.journal, self.groups, self.config, at_most=known_rows(self.journal))
        return risk.risk_by_employee(errors)

    @cached_property
    def features(self) -> DataFrame:
        self._beside("groups", "payments")
        return durable(build_features(self.ledger, self.groups, self.payments, self.journal, self.config))

    @cached_property
    def checks(self) -> DataFrame:
        return integrity_checks(self)


def reconcile(sources: Sources, config: Config = DEFAULT) -> Result:
    """Plan the reconciliation of three raw tables (see sources.files for their columns)."""
    return Result(sources, config)
