"""Index builders and the queries over them."""
