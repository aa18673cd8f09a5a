"""DataFrame -> DataFrame operators (cleaning, features, summaries, association, modelling,
clustering, anomalies, PCA) and the shared row-position / neighbour machinery."""
