"""Canonical input schemas as DDL (one place)."""

TRANSFERS = (
    "signature string, wallet string, sender string, receiver string, amount_lamports bigint, ts bigint, "
    "slot bigint, program_id string, token string, err string"
)
ENRICHED_TX = (
    "signature string, transactionSignature string, txHash string, hash string, timestamp bigint, blockTime bigint, "
    "instructions array<struct<programId: string>>, "
    "nativeTransfers array<struct<fromUserAccount: string, toUserAccount: string, amount: string>>, "
    "tokenTransfers array<struct<fromUserAccount: string, fromTokenAccount: string, toUserAccount: string, "
    "toTokenAccount: string, mint: string, tokenMint: string, tokenAmount: string, amount: string>>"
)
ASSET = (
    "id string, content struct<metadata: struct<name: string, symbol: string, "
    "creators: array<struct<address: string, creator: string>>>>, "
    "token_info struct<supply: bigint, decimals: int, mint_authority: string, mintAuthority: string, "
    "freeze_authority: string, freezeAuthority: string>, "
    "supply bigint, decimals int, mint_authority string, mintAuthority string, freeze_authority string, "
    "freezeAuthority string, "
    "authorities array<struct<type: string, authority_type: string, address: string, authority: string>>"
)
USAGE = ("api_key string, endpoint string, status int, response_ms double, ts bigint")
EVIDENCE = (
    "wallet string, reason_code string, tx_signature string, counterparty string, amount bigint, timestamp bigint"
)
