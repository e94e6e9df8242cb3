"""canopy: analytics of source trees and other hierarchical text corpora on Spark DataFrames."""
