"""Parameters of the registered queries on the driver tables.

The original analyses carry placeholder periods; on the driver tables
(events of 2024-01) the registered queries cover the whole table.
"""

ACTION_SINCE = "20240101"          # open-ended action period (>=)
PERIOD = ("20240101", "20240131")  # bounded shard period (BETWEEN)
EXPORT_PERIOD = ("20240108", "20240121")   # a narrower period: some daily tables before and after it
FORMATS_PER_PARAM = 5
PAGE_PATH_DEPTH = 10          # Purchase run, and the report width
PAGE_PATH_DEPTH_HOLD = 7      # Booking Hold run
FUNNEL_TOUCHPOINTS = 10
EXPERIMENT_ID = "exp_popup"
SAMPLE_PER_VARIANT = 4000
TRAIN_ANCHORS = ("2024-01-04", "2024-01-16", 3)   # start, end, step days
SCORE_ANCHORS = ("2024-01-10", "2024-01-16", 1)
LOOKBACK_DAYS = 30
HORIZON_DAYS = 14
TEST_SHARE = 0.2
SPLIT_SEED = 42
