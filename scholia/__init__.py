"""scholia: full-text corpus analytics on Spark.

Typical use::

    from scholia.session import get_spark
    from scholia.operators import quotations as Q, language as L

    spark = get_spark()
    corpus = Q.ReferenceCorpus.build(spark.read.parquet(verses_path))
    found = Q.find_quotations(spark.read.parquet(pages_path), corpus)

    profiles = L.Profiles.build(L.train_profiles(spark.read.parquet(labelled_path)))
    counts = L.language_counts(L.sentence_languages(pages, profiles, keys=["item_id", "page_seq"]))

Every operator takes and returns DataFrames; nothing runs until an action
or a writer is called (except building the reference corpus and the
language profiles, which are materialised once in the shared checkpoint
folder).
"""
