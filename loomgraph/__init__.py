"""Text retrieval and knowledge-graph analytics as composable DataFrame operators on Spark."""
