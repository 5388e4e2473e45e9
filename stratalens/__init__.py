"""Analytics over source trees and text corpora as Spark DataFrame operators."""
