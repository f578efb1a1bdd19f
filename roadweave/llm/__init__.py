"""Training-data operators: ten corpus-scale jobs over tables of texts.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries.py`` binds them to the tables as ``opN_<name>``.
"""
