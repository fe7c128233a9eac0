"""Which agent a name stands for, decided by the tickets it shares with the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.text import norm_text
from triledger.operators.durable import durable, known_rows, side_by_side
from triledger.operators.skew import salted_join


@dataclass(frozen=True)
class Votes:
    ticket_agent: DataFrame      # ticket, agent: ledger tickets, then statement tickets
    ledger_tickets: DataFrame    # ticket, agent, rows, conflicts
    folders: DataFrame           # folder, agent, shared_tickets, confidence
    parties: DataFrame           # party, agent, shared_tickets, confidence


def ticket_owners(ledger: DataFrame) -> DataFrame:
    """The first agent of every ticket in (agent, time) order, and how many rows disagree."""
    rows = ledger.filter(F.col("agent").isNotNull()).select("agent", F.explode("tickets").alias("ticket"))
    pairs = rows.groupBy("ticket", "agent").agg(F.count("*").alias("n"))
    return pairs.groupBy("ticket").agg(
        F.min("agent").alias("agent"),
        F.sum("n").alias("rows"),
        (F.sum("n") - F.min_by("n", "agent")).alias("conflicts"),
    )


def occurrences(rows: DataFrame, name: str, order: str) -> DataFrame:
    """One row per (name, ticket): how often it occurs and where first."""
    exploded = rows.filter(F.col(name).isNotNull()).select(name, order, F.posexplode("tickets").alias("pos", "ticket"))
    return exploded.groupBy(name, "ticket").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first"))


def vote(seen: DataFrame, owners: DataFrame, name: str, hot_rows: int, at_most: int | None = None) -> DataFrame:
    """Per name, the agent with most shared tickets; a tie goes to the one seen first."""
    owned = salted_join(seen, owners.select("ticket", "agent"), ["ticket"], how="inner", hot_rows=hot_rows, at_most=at_most)
    counts = owned.groupBy(name, "agent").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # max_by over (n, earliest first): negate the count and take the minimum.
    rank = F.struct((-F.col("n")).alias("n"), F.col("first"))
    return counts.groupBy(name).agg(
        F.min_by("agent", rank).alias("agent"),
        F.max("n").alias("shared_tickets"),
        (F.max("n") / F.sum("n")).alias("confidence"),
    )


def folder_agents(latest: DataFrame, ledger: DataFrame, seen: DataFrame, owners: DataFrame, hot_rows: int) -> DataFrame:
    """Folders by vote, else by equal name, else unmapped."""
    voted = vote(seen, owners, "folder", hot_rows, known_rows(seen))
    by_name = (
        ledger.filter(F.col("agent").isNotNull()).select("agent").distinct()
        .groupBy(norm_text(F.col("agent")).alias("_name")).agg(F.max("agent").alias("_named")))
    folders = latest.select("folder").distinct().withColumn("_name", norm_text(F.col("folder")))
    joined = folders.join(voted, "folder", "left").join(by_name, "_name", "left")
    named = F.col("_named").isNotNull()
    return joined.select(
        "folder",
        F.coalesce("agent", "_named", F.concat(F.lit("UNMAPPED:"), "folder")).alias("agent"),
        F.coalesce("shared_tickets", F.lit(0)).cast("bigint").alias("shared_tickets"),
        F.coalesce("confidence", F.when(named, F.lit(1.0)).otherwise(F.lit(0.0))).alias("confidence"),
    )


def resolve(latest: DataFrame, ledger: DataFrame, journal: DataFrame, config: Config) -> Votes:
    owners, seen = side_by_side(
        ledger.sparkSession,
        lambda: durable(ticket_owners(ledger)),
        lambda: durable(occurrences(latest, "folder", "line_no")))
    folders = durable(folder_agents(latest, ledger, seen, owners, config.hot_rows))

    # Tickets the ledger does not know belong to the folder that names them first.
    unknown = salted_join(seen, folders.select("folder", "agent"), ["folder"], how="inner",
                          hot_rows=config.hot_rows, at_most=known_rows(seen), lookup_rows=known_rows(folders)).select(
        "ticket", F.lit(1).alias("source"), "first", "agent")
    known = owners.select(
        "ticket", F.lit(0).alias("source"),
        F.lit(None).cast(seen.schema["first"].dataType).alias("first"), "agent")
    ticket_agent = durable(known.unionByName(unknown).groupBy("ticket").agg(
        F.min_by("agent", F.struct("source", "first")).alias("agent")))

    # A row names a ticket once, so no ticket has more rows than the journal.
    named = occurrences(journal, "party", "row_no")
    parties = durable(vote(named, ticket_agent, "party", config.hot_rows, known_rows(journal)))
    return Votes(ticket_agent, owners, folders, parties)


def evidence(votes: Votes) -> DataFrame:
    """How every name of the statements and the journal was resolved."""
    def part(df, source, name):
        return df.select(
            F.lit(source).alias("source"), F.col(name).alias("name_in_source"), "agent", "shared_tickets", "confidence")

    return part(votes.folders, "statements", "folder").unionByName(part(votes.parties, "journal", "party")) \
        .orderBy("source", "confidence", "name_in_source")


def statement_agents(latest: DataFrame, votes: Votes, config: Config) -> DataFrame:
    return salted_join(latest, votes.folders.select("folder", "agent"), ["folder"], how="inner",
                       hot_rows=config.hot_rows, at_most=known_rows(latest), lookup_rows=known_rows(votes.folders))


def journal_agents(journal: DataFrame, votes: Votes, config: Config) -> DataFrame:
    """The agent of each journal row: its own tickets, then its party, else a direct client."""
    tickets = journal.select("row_no", F.posexplode("tickets").alias("pos", "ticket"))
    # A row names a ticket once, so no ticket has more rows than the journal.
    owned = salted_join(tickets, votes.ticket_agent, ["ticket"], how="inner",
                        hot_rows=config.hot_rows, at_most=known_rows(journal))
    counts = owned.groupBy("row_no", "agent").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    by_ticket = counts.groupBy("row_no").agg(
        F.max_by("agent", F.struct("n", -F.col("pos"))).alias("_by_ticket"))
    parties = votes.parties.select(
        "party", F.col("agent").alias("_by_party"), (F.col("confidence") >= config.vote_share).alias("_sure"))
    joined = salted_join(journal.join(by_ticket, "row_no", "left"), parties, ["party"],
                         hot_rows=config.hot_rows, at_most=known_rows(journal), lookup_rows=known_rows(votes.parties))
    return joined.select(
        *journal.columns,
        F.coalesce(
            "_by_ticket",
            F.when(F.col("_sure"), F.col("_by_party")).when(~F.col("_sure"), "UNASSIGNED").otherwise("DIRECT_CLIENT"),
        ).alias("agent"),
    )
