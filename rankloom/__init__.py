"""rankloom: ranked-list analytics and data preparation on Spark."""
