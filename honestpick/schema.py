"""Column contracts shared by the operators."""

# What an arm-level file must carry before it is prepared (all text, cast later).
RAW_ARM_COLUMNS = ["test_id", "split", "source_row_id", "impressions", "clicks",
                   "first_place", "winner"]

# Families in presentation order, all other estimators after them (R21).  A name
# that ends in * stands for all that begin so.
ESTIMATOR_FAMILIES = [("none",), ("standard",), ("moon*",), ("bayes_*", "eb_*"),
                      ("conditional_si", "si_conditional", "hybrid_si"), ("split*",)]
