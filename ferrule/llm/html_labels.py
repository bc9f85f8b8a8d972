"""Small labelled table of text blocks for the block classifier.

One row a block, in page order: page, elements around the block (outermost first, with the class
or id where it says something), words, words inside links, 1 if the block belongs to the article.
Written by hand after common page layouts.
"""

BLOCKS = """
news    nav>ul>li                         1  1 0
news    nav>ul>li                         2  2 0
news    nav>ul>li                         1  1 0
news    div.ad>p                         12  0 0
news    article>h1                        9  0 1
news    article>p                        58  0 1
news    article>p                         1  0 1
news    article>p                       120  3 1
news    article>p                         2  0 1
news    article>ul>li                     6  0 1
news    article>p                        33 20 1
news    footer>p                         14  0 0
blog    header>h1                         3  3 0
blog    header>p                          8  0 0
blog    header>nav>ul>li                  1  1 0
blog    main>article>header>h1            6  0 1
blog    main>article>p                   44  0 1
blog    main>article>p                    3  0 1
blog    main>article>blockquote>p        25  0 1
blog    main>article>p                   70  8 1
blog    main>article>footer>p             6  4 0
blog    main>section.comments>h2          2  0 0
blog    main>section.comments>article.comment>p   40  0 0
blog    main>section.comments>article.comment>p    3  0 0
blog    main>section.comments>form>label           2  0 0
blog    aside>h3                          2  0 0
blog    aside>ul>li                       5  5 0
blog    aside>p                          30  0 0
blog    footer>p                          9  1 0
plain   p                                40  0 1
plain   p                                65  2 1
plain   h2                                4  0 1
plain   p                                22  0 1
plain   p                                90  0 1
plain   ul>li                             9  0 1
plain   p                                30  0 1
forum   div.navbar>a                      1  1 0
forum   div.breadcrumb>a                  3  3 0
forum   div#content>h1                    7  0 1
forum   div#content>div.post>p           35  0 1
forum   div#content>div.post>p            4  0 1
forum   div#content>div.post>p           80  6 1
forum   div#content>div.share>a           2  2 0
forum   div#content>div.related>h3        2  0 0
forum   div#content>div.related>ul>li     7  7 0
forum   div#comments>div>p               50  0 0
forum   div#comments>div>p                6  0 0
forum   div.sidebar>p                    28  0 0
forum   div.sidebar>ul>li                 4  4 0
forum   div.footer>p                     11  3 0
shop    div.cookie>p                     25  2 0
shop    div.cookie>p                      4  0 0
shop    div.notice>p                     15  0 0
shop    div>ul>li                         2  2 0
shop    div>ul>li                         1  1 0
shop    div>ul>li                         3  3 0
shop    div>h1                            6  0 1
shop    div>p                            48  0 1
shop    div>p                            75  4 1
shop    div>p                            31  0 1
shop    div>ul>li                         3  3 0
shop    div>ul>li                         2  2 0
shop    form>label                        3  0 0
shop    form>p                           20  0 0
shop    div                               2  2 0
shop    div                               6  5 0
old     table>tr>td                       1  1 0
old     table>tr>td                       2  2 0
old     table>tr>td                       1  1 0
old     table>tr>td>h2                    5  0 1
old     table>tr>td>p                    60  0 1
old     table>tr>td>p                    45  1 1
old     table>tr>td>p                    85  0 1
old     table>tr>td                       2  2 0
old     table>tr>td                       3  3 0
old     table>tr>td                       1  1 0
wiki    main>h1                           2  0 1
wiki    main>p                           95 18 1
wiki    main>p                            5  0 1
wiki    main>h2                           1  0 1
wiki    main>ul>li                        8  6 1
wiki    main>p                           12  3 1
wiki    main>div.toc.nav>ul>li            3  3 0
wiki    main>div.sidebar>p               26  4 0
wiki    footer>ul>li                      2  2 0
wiki    footer>p                         40  5 0
promo   div.banner>p                     10  0 0
promo   aside.advert>p                   35  0 0
promo   article.story>h1                  8  0 1
promo   article.story>p                  30  0 1
promo   article.story>div.advert>p       18  0 0
promo   article.story>p                   1  0 1
promo   article.story>aside>p            22  0 0
promo   article.story>div.newsletter>p   16  1 0
promo   article.story>p                  66  0 1
promo   article.story>nav>a               2  2 0
promo   div.comment-list>div>p           33  0 0
promo   div.footer>p                     45  2 0
bare    div                               4  4 0
bare    div                               3  0 0
bare    div                               5  5 0
bare    div                              60  0 1
bare    div                               4  0 1
bare    div                              70  2 1
bare    div                               6  6 0
bare    div                               7  0 0
bare    div                               3  3 0
links   td                                2  2 0
links   td                                4  0 0
links   td                                3  3 0
links   td                                8  0 1
links   td                               80  3 1
links   td                                2  0 1
links   td                               50  0 1
links   td                                2  2 0
links   td                                5  0 0
links   td                                2  2 0
"""
