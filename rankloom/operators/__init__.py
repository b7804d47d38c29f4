"""DataFrame-to-DataFrame operators. Rankings are long: query_key, item_id, rank."""
