"""Declared schemas of the stored tables and of the raw records."""

from __future__ import annotations

STORED = {
    "markets": """condition_id string, market_slug string, question string, description string, event_id string,
        event_title string, event_slug string, neg_risk int, category string, tags array<string>, outcomes array<string>,
        outcome_prices array<double>, token_ids array<string>, active int, closed int, resolved int,
        resolution_source string, winning_outcome string, volume_24h double, volume_total double, liquidity double,
        volume_1wk double, volume_1mo double, competitive_score double, one_day_price_change double,
        one_week_price_change double, start_date timestamp, end_date timestamp, created_at timestamp, updated_at timestamp""",
    "market_prices": """condition_id string, token_id string, outcome string, price double, bid double, ask double,
        volume double, timestamp timestamp""",
    "market_trades": """condition_id string, token_id string, outcome string, price double, size double, side string,
        trade_id string, timestamp timestamp""",
    "orderbook_snapshots": """condition_id string, token_id string, outcome string, bid_prices array<double>,
        bid_sizes array<double>, ask_prices array<double>, ask_sizes array<double>, snapshot_time timestamp""",
    "market_events": "condition_id string, event_type string, event_data string, event_time timestamp",
    "trader_rankings": """proxy_wallet string, user_name string, profile_image string, rank int, category string,
        time_period string, order_by string, pnl double, volume double, verified_badge int, x_username string,
        snapshot_time timestamp""",
    "market_holders": """condition_id string, token_id string, proxy_wallet string, pseudonym string,
        profile_image string, outcome_index int, amount double, snapshot_time timestamp""",
    "wallet_positions": """proxy_wallet string, condition_id string, asset string, outcome string, outcome_index int,
        size double, avg_price double, initial_value double, current_value double, cur_price double, cash_pnl double,
        percent_pnl double, realized_pnl double, title string, market_slug string, end_date timestamp, updated_at timestamp""",
    "wallet_activity": """proxy_wallet string, condition_id string, asset string, activity_type string, side string,
        outcome string, outcome_index int, size double, usdc_size double, price double, transaction_hash string,
        title string, market_slug string, timestamp timestamp""",
    "trader_profiles": """proxy_wallet string, pseudonym string, name string, bio string, profile_image string,
        x_username string, verified_badge int, display_username_public int, profile_created_at timestamp,
        discovered_via string, updated_at timestamp""",
}

# time column that a table is partitioned by (month), and how long it is kept in days
RETENTION = {
    "market_prices": ("timestamp", 730),
    "market_trades": ("timestamp", 730),
    "orderbook_snapshots": ("snapshot_time", 7),
    "market_events": ("event_time", 365),
    "wallet_activity": ("timestamp", 365),
}

RAW_EVENT = """id string, slug string, title string, tags array<struct<label: string>>, markets array<struct<
    conditionId: string, slug: string, question: string, description: string, negRisk: boolean, outcomes: string,
    outcomePrices: string, clobTokenIds: string, active: boolean, closed: boolean, umaResolutionStatus: string,
    resolutionSource: string, volume24hr: double, volumeNum: double, volume: double, liquidityNum: double,
    liquidity: double, volume1wk: double, volume1mo: double, competitive: double, oneDayPriceChange: double,
    oneWeekPriceChange: double, startDate: string, endDate: string, createdAt: string>>"""

RAW_TRADE = """conditionId string, asset string, size double, price double, side string, timestamp string,
    outcome string, transactionHash string"""

RAW_LEADER = "proxyWallet string, userName string, profileImage string, rank int, pnl double, vol double, verifiedBadge boolean, xUsername string"
RAW_POSITION = """proxyWallet string, conditionId string, asset string, outcome string, outcomeIndex int, size double,
    avgPrice double, initialValue double, currentValue double, curPrice double, cashPnl double, percentPnl double,
    realizedPnl double, title string, slug string, endDate string"""
RAW_ACTIVITY = """proxyWallet string, conditionId string, asset string, type string, side string, outcome string,
    outcomeIndex int, size double, usdcSize double, price double, transactionHash string, title string, slug string, timestamp string"""
RAW_HOLDERS = "token string, holders array<struct<proxyWallet: string, pseudonym: string, profileImage: string, outcomeIndex: int, amount: double>>"
RAW_PROFILE = """proxyWallet string, pseudonym string, name string, bio string, profileImage string, xUsername string,
    verifiedBadge boolean, displayUsernamePublic boolean, createdAt string"""
RAW_BOOK = "market string, asset_id string, timestamp string, bids array<struct<price: string, size: string>>, asks array<struct<price: string, size: string>>"
SOCKET_MESSAGE = """event_type string, market string, asset_id string, price string, size string, side string, timestamp string,
    price_changes array<struct<asset_id: string, price: string, best_bid: string, best_ask: string>>,
    buys array<struct<price: string, size: string>>, sells array<struct<price: string, size: string>>"""
