"""terrane: code models, scope trees and incremental reports as Spark relations."""
