"""Training-data operators: near-duplicates, scoring, mixing, leaks, secrets, urls, personal data,
chat formatting, quality and licences. Nothing outside this folder imports it."""
