"""Explicit schemas of the feed files and stored tables."""

from __future__ import annotations

FEED_ITEM = (
    "id STRING, title STRING, area STRING, dist STRING, time STRING, registeredAt STRING, updatedAt STRING, "
    "price STRING, likes INT, dislikes INT, views INT, comments INT, commentSignalScore INT, "
    "positiveCommentSignals INT, negativeCommentSignals INT, qualitySignalParserVersion INT, category STRING, "
    "desc STRING, img STRING, detailImg STRING, buyLink STRING, sourceLink STRING, source STRING, date STRING"
)
FEED_FILE = (
    "source STRING, sourceKey STRING, partialSnapshot BOOLEAN, staleFallback BOOLEAN, generatedAt STRING, "
    "rangeHours INT, since STRING, today STRING, yesterday STRING, "
    "counts STRUCT<today: INT, yesterday: INT, total: INT>, "
    f"items ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in FEED_ITEM.split(', '))}>>, "
    f"grouped STRUCT<today: ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in FEED_ITEM.split(', '))}>>, "
    f"yesterday: ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in FEED_ITEM.split(', '))}>>>, "
    "expiredPostIds ARRAY<STRING>"
)
DEALS = (
    "id STRING, source STRING, source_post_id STRING, source_link STRING, buy_link STRING, title STRING, "
    "desc STRING, price STRING, category STRING, img STRING, detail_img STRING, area STRING, dist STRING, "
    "time STRING, likes INT, dislikes INT, views INT, comments INT, comment_signal_score INT, "
    "positive_comment_signals INT, negative_comment_signals INT, manual_temperature INT, date STRING, "
    "registered_at TIMESTAMP, deleted_at TIMESTAMP, edited BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
)
FAVORITES = "user_id STRING, deal_key STRING, created_at TIMESTAMP"
READ_MARKS = "user_id STRING, deal_key STRING, created_at TIMESTAMP"
COMMENTS = (
    "id STRING, deal_key STRING, nickname STRING, body STRING, guest_key STRING, created_at TIMESTAMP"
)
SNAPSHOTS = (
    "id STRING, source STRING, captured_at TIMESTAMP, model_version SMALLINT, sample_count INT, "
    "metrics MAP<STRING, STRUCT<mean: DOUBLE, variance: DOUBLE, stddev: DOUBLE, min: DOUBLE, p25: DOUBLE, "
    "p50: DOUBLE, p75: DOUBLE, p90: DOUBLE, p95: DOUBLE, max: DOUBLE, nonzero_rate: DOUBLE>>"
)
BOARD_POSTS = (
    "id STRING, title STRING, body STRING, img STRING, author STRING, views INT, deleted_at TIMESTAMP, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
REPORTS = (
    "id STRING, target_type STRING, target_id STRING, reason STRING, reporter STRING, status STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
NOTICES = (
    "id STRING, title STRING, body STRING, published BOOLEAN, starts_at TIMESTAMP, ends_at TIMESTAMP, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
PROFILES = "user_key STRING, provider STRING, nickname STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
SUBSCRIPTIONS = "id STRING, uid STRING, term STRING, term_normalized STRING, enabled BOOLEAN, updated_at TIMESTAMP"
DEVICES = (
    "id STRING, uid STRING, enabled BOOLEAN, client_kind STRING, display_mode STRING, installation_id STRING, "
    "user_agent STRING, endpoint STRING, fcm_token STRING, last_seen_at TIMESTAMP, updated_at TIMESTAMP, "
    "created_at TIMESTAMP"
)
LEDGER = "deal_id STRING, uid STRING, status STRING, reason STRING, sent_at TIMESTAMP"
