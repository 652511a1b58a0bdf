"""Training-data operators: ten corpus-preparation operators and their registered queries.

Nothing outside this folder imports it; the entry file adds its queries when it is present.
"""
