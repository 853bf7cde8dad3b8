def rows_of_documents(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]
