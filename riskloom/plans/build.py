"""The feature build as a committed build (SNK-01..05, SRC-08..10): tables of the reference's outputs and the application,
each computed again only if its inputs or its definition changed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.committed import Build, Table
from . import features as fe
from . import processed as pr
from . import specs

VERSION = "1"  # of the derivations that the feature lists do not hold


def _definition(*lists) -> str:
    return VERSION + repr(lists)


def _processed(t) -> DataFrame:
    return pr.encode(pr.recode(t["application_table"].join(t["bureau_agg"], "SK_ID_CURR", "left")))[0]


def _previous(t) -> DataFrame:
    pos = fe.child_written(fe.pos_cash_agg(t["pos_cash"]))
    enriched = fe.previous_with(t["previous_application"], pos, t["installments_agg"], t["credit_card_agg"])
    return fe.previous_rollup(enriched, previous=t["previous_application"])


TABLES = [
    Table("application_table", "SK_ID_CURR", ["application"], lambda t: t["application"], _definition()),
    Table("bureau_agg", "SK_ID_CURR", ["bureau", "bureau_balance"], lambda t: fe.bureau_agg(t["bureau"], t["bureau_balance"]),
          _definition(specs.BUREAU_BALANCE, specs.BUREAU)),
    Table("installments_agg", "SK_ID_PREV", ["installments"], lambda t: fe.installments_agg(t["installments"], measure=True),
          _definition(specs.INSTALLMENTS, specs.LAST_K, fe.INSTALLMENT_TIES)),
    Table("credit_card_agg", "SK_ID_PREV", ["credit_card"], lambda t: fe.credit_card_agg(t["credit_card"], measure=True),
          _definition(specs.CREDIT_CARD, specs.LAST_K, fe.CARD_TIES)),
    Table("previous_agg", "SK_ID_CURR", ["previous_application", "pos_cash", "installments_agg", "credit_card_agg"], _previous,
          _definition(specs.POS_CASH, specs.PREVIOUS, specs.LAST_K, fe.PREVIOUS_TIES)),
    Table("processed", "SK_ID_CURR", ["application_table", "bureau_agg"], _processed, _definition()),
]


def application_bureau(build: Build) -> DataFrame:
    """J2 on committed tables."""
    return build.table("application_table").join(build.table("bureau_agg"), "SK_ID_CURR", "left")


def application_previous(build: Build) -> DataFrame:
    """J6 on committed tables."""
    return build.table("application_table").join(build.table("previous_agg"), "SK_ID_CURR", "left")
