from vetgrid.rules.catalog import (
    ALL_RULES,
    CATEGORIES,
    SEVERITIES,
    Rule,
    rules_dataframe,
    select_rules,
)

__all__ = ["ALL_RULES", "CATEGORIES", "SEVERITIES", "Rule", "rules_dataframe", "select_rules"]
