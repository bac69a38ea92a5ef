"""Training-data operators on Spark (text, conversations, embeddings).

One module per operator; ``catalog`` holds the registered queries and their SQL.
Nothing else in the library imports this subpackage.
"""
