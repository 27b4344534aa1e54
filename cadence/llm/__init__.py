"""Training-data pipeline operators.

Thirteen operators on documents, vectors and conversations, their registered
queries (``queries``) and the code they share (``common``).  Nothing else in
the library imports this subpackage.
"""
